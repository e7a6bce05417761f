"""DuckDB statements equivalent to the registered queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

PHOTOS = """
photos AS (
  SELECT event_id AS image_id, user_id AS owner,
         CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) // 1000 END AS taken_unix_ms,
         CASE WHEN event_id % 5 <> 0 THEN CAST(40 + user_id % 10 + CASE WHEN event_id % 23 = 0 THEN 20 ELSE 0 END AS DOUBLE)
              + (event_id % 7) * CAST(0.01 AS DOUBLE) END AS latitude,
         CASE WHEN event_id % 5 <> 0 THEN CAST(-70 + user_id % 20 AS DOUBLE)
              + (event_id % 11) * CAST(0.01 AS DOUBLE) END AS longitude,
         CAST(100000 + floor(value * 1000) AS BIGINT) AS size_bytes
  FROM events)"""


def _steps(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return PHOTOS + f""",
lagged AS (
  SELECT *, lag(taken_unix_ms) OVER w AS pt, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon
  FROM photos WHERE taken_unix_ms IS NOT NULL
  WINDOW w AS ({part}ORDER BY taken_unix_ms, image_id)),
steps AS (
  SELECT *, taken_unix_ms - pt AS gap_ms,
         CASE WHEN latitude IS NOT NULL AND plat IS NOT NULL THEN
           2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(latitude - plat) / 2), 2)
             + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2)))) END AS km
  FROM lagged)"""


def _assigned(by: str, hours: int = 48, km: int = 300) -> str:
    part = f"PARTITION BY {by} " if by else ""
    part2 = f"{by}, " if by else ""
    return _steps(by) + f""",
assigned AS (
  SELECT *, sum(CASE WHEN pt IS NULL OR gap_ms > {hours} * 3600000 OR (km IS NOT NULL AND km > {km}) THEN 1 ELSE 0 END)
              OVER ({part}ORDER BY taken_unix_ms, image_id ROWS UNBOUNDED PRECEDING)::BIGINT AS trip_id
  FROM steps),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {part2}trip_id ORDER BY taken_unix_ms, image_id) AS pos FROM assigned)"""


_TRIP_COLUMNS = """min(taken_unix_ms) AS start_unix_ms, max(taken_unix_ms) AS end_unix_ms, count(*) AS photos,
       round(avg(latitude), 6) AS centroid_lat, round(avg(longitude), 6) AS centroid_lon"""

ORACLES["trip_list"] = f"WITH {_assigned('owner')} SELECT owner, trip_id, {_TRIP_COLUMNS} FROM assigned GROUP BY owner, trip_id"
ORACLES["trip_photos"] = f"WITH {_assigned('owner')} SELECT owner, trip_id, pos, image_id FROM numbered"
ORACLES["trip_id_arrays"] = f"""WITH {_assigned('owner')}
SELECT owner, trip_id, (pos - 1) // 100 AS chunk_no, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY pos) AS image_ids
FROM numbered GROUP BY owner, trip_id, chunk_no"""
ORACLES["trip_summary"] = f"""WITH {_assigned('owner')}
SELECT (SELECT count(*) FROM (SELECT DISTINCT owner, trip_id FROM assigned)) AS trips,
       (SELECT count(*) FROM photos WHERE taken_unix_ms IS NULL) AS unassigned"""
ORACLES["trips_one_library"] = f"WITH {_assigned('', 1, 1000)} SELECT trip_id, {_TRIP_COLUMNS} FROM assigned GROUP BY trip_id"
_PAIRS = ", ".join(f"({g}, {d})" for g in (12, 24, 48, 168) for d in (10, 300, 1000))
ORACLES["trip_sweep"] = f"""WITH {_steps('owner')},
settings(g, d) AS (VALUES {_PAIRS})
SELECT CAST(g AS DOUBLE) AS max_gap_hours, CAST(d AS DOUBLE) AS max_distance_km,
       count(*) FILTER (WHERE pt IS NULL OR gap_ms > g * 3600000 OR (km IS NOT NULL AND km > d)) AS trips
FROM steps, settings GROUP BY g, d"""
ORACLES["photo_steps"] = f"WITH {_steps('owner')} SELECT image_id, gap_ms, round(km, 6) AS km FROM steps"

ORACLES["density_clusters"] = f"""WITH RECURSIVE {PHOTOS},
pts AS (SELECT * FROM photos WHERE taken_unix_ms IS NOT NULL AND latitude IS NOT NULL),
near AS (
  SELECT a.image_id AS a, b.image_id AS b
  FROM pts a JOIN pts b ON b.taken_unix_ms BETWEEN a.taken_unix_ms - 10800000 AND a.taken_unix_ms + 10800000
  WHERE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2)
    + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) <= 50),
cores AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)),
reach(a, b) AS (SELECT id, id FROM cores UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT a AS id, min(b) AS cluster_id FROM reach GROUP BY a),
border AS (SELECT near.a AS id, min(cluster_id) AS cluster_id FROM near JOIN named ON named.id = near.b GROUP BY near.a)
SELECT image_id, coalesce(named.cluster_id, border.cluster_id) AS cluster_id, named.id IS NOT NULL AS is_core
FROM pts LEFT JOIN named ON named.id = image_id LEFT JOIN border ON border.id = image_id"""

# --- decisions ---------------------------------------------------------------

ACTIONS = """
actions AS (
  SELECT event_id AS seq, user_id // 10 AS grp, user_id,
         CASE WHEN event_type = 'error' AND event_id % 1000 = 0 THEN 'reset'
              WHEN event_type = 'error' THEN 'keep_all' WHEN event_type = 'click' THEN 'toggle'
              WHEN event_type = 'view' THEN 'keep' WHEN event_type = 'purchase' THEN 'mark'
              WHEN event_type = 'signup' THEN 'assign_keeper' END AS action
  FROM events),
live AS (SELECT * FROM actions WHERE seq > (SELECT coalesce(max(seq), -1) FROM actions WHERE action = 'reset')),
per_image AS (
  SELECT seq, action, user_id AS image_id FROM live WHERE action IN ('toggle', 'keep', 'mark')
  UNION ALL
  SELECT seq, action, unnest(generate_series(grp * 10, grp * 10 + 9)) AS image_id FROM live WHERE action = 'keep_all'),
dated AS (
  SELECT *, max(CASE WHEN action <> 'toggle' THEN seq END) OVER (PARTITION BY image_id) AS set_seq FROM per_image),
folded AS (
  SELECT image_id, max(seq) AS updated_at,
         max(CASE WHEN seq = set_seq THEN action END) AS base,
         count(*) FILTER (WHERE action = 'toggle' AND (set_seq IS NULL OR seq > set_seq)) AS k
  FROM dated GROUP BY image_id),
decisions AS (
  SELECT image_id, updated_at,
         CASE WHEN k % 2 = 0 AND base = 'mark' THEN 'EXPLICIT_DELETE'
              WHEN k % 2 = 0 THEN 'EXPLICIT_KEEP'
              WHEN base = 'mark' THEN 'EXPLICIT_KEEP' ELSE 'EXPLICIT_DELETE' END AS decision
  FROM folded),
keepers AS (SELECT grp AS group_id, arg_max(user_id, seq) AS keeper_id FROM live WHERE action = 'assign_keeper' GROUP BY grp),
members AS (
  SELECT g AS group_id, unnest(generate_series(g * 10, g * 10 + 9)) AS image_id, g * 10 AS recommended_id
  FROM (SELECT DISTINCT user_id // 10 AS g FROM events)),
keeper_of AS (
  SELECT m.image_id, arg_max(coalesce(k.keeper_id, m.recommended_id), m.group_id) AS keeper_id
  FROM members m LEFT JOIN keepers k USING (group_id) GROUP BY m.image_id),
verdict AS (
  SELECT m.image_id, d.decision, m.image_id % 4 = 0 AS quality, m.image_id % 9 = 0 AS junk,
         k.keeper_id IS NOT NULL AND k.keeper_id <> m.image_id AS loser
  FROM members m LEFT JOIN decisions d USING (image_id) LEFT JOIN keeper_of k USING (image_id))"""


def _resolved(default: str) -> str:
    return f"CASE WHEN decision = 'EXPLICIT_DELETE' THEN true WHEN decision = 'EXPLICIT_KEEP' THEN false ELSE {default} END"


ORACLES["user_decisions"] = f"WITH {ACTIONS} SELECT image_id, decision, updated_at FROM decisions"
ORACLES["group_keepers"] = f"WITH {ACTIONS} SELECT group_id, keeper_id FROM keepers"
ORACLES["saved_decisions"] = f"""WITH {ACTIONS}
SELECT CASE decision WHEN 'EXPLICIT_KEEP' THEN 'explicit_kept' ELSE 'explicit_deleted' END AS kind,
       CAST(image_id AS VARCHAR) AS value FROM decisions
UNION ALL SELECT 'keeper', group_id || ':' || keeper_id FROM keepers"""
ORACLES["keeper_map"] = f"WITH {ACTIONS} SELECT image_id, keeper_id FROM keeper_of"
ORACLES["marked_by_step"] = f"WITH {ACTIONS} " + " UNION ALL ".join(
    f"SELECT image_id, {_resolved(column)} AS marked, '{step}' AS step FROM verdict"
    for step, column in [("quality", "quality"), ("junk", "junk"), ("similar", "loser"), ("none", "false")]
)
ORACLES["marked_similar"] = f"WITH {ACTIONS} SELECT count(*) FILTER (WHERE {_resolved('loser')}) AS marked_count FROM verdict"
_ANY = _resolved("quality OR junk OR loser")
ORACLES["final_keep"] = f"WITH {ACTIONS} SELECT image_id, {_ANY} AS deleted FROM verdict"
ORACLES["keep_summary"] = f"""WITH {ACTIONS}
SELECT count(*) FILTER (WHERE NOT {_ANY}) AS keep_count,
       CAST(coalesce(sum(image_id * 1000 + 7) FILTER (WHERE NOT {_ANY}), 0) AS BIGINT) AS keep_bytes,
       count(*) FILTER (WHERE {_ANY}) AS left_behind FROM verdict"""

# --- commit --------------------------------------------------------------------

MANIFEST = """
library AS (
  SELECT 'y' || year(o_orderdate) || '/' || o_orderkey || '.jpg' AS id, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
         o_orderkey AS k FROM orders),
kept AS (SELECT id FROM library WHERE k % 2 = 0 UNION ALL SELECT 'missing/' || k FROM library WHERE k % 101 = 0),
there AS (SELECT id, size_bytes + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS there_bytes FROM library WHERE k % 3 = 0),
planned AS (
  SELECT kept.id, '/out/' || kept.id AS target, size_bytes,
         CASE WHEN size_bytes IS NULL THEN 'unknown' WHEN there_bytes IS NULL THEN 'copy'
              WHEN there_bytes = size_bytes THEN 'present' ELSE 'conflict' END AS status
  FROM kept LEFT JOIN library USING (id) LEFT JOIN there USING (id)),
manifest AS (
  SELECT *, CASE status WHEN 'conflict' THEN id || ': name conflict' WHEN 'unknown' THEN id || ': unknown image id' END AS error
  FROM planned)"""
ORACLES["commit_manifest"] = f"WITH {MANIFEST} SELECT * FROM manifest"
ORACLES["commit_progress"] = f"""WITH {MANIFEST}
SELECT id, row_number() OVER w AS done, count(*) OVER () AS total,
       CAST(sum(size_bytes) OVER w AS BIGINT) AS done_bytes, CAST(sum(size_bytes) OVER () AS BIGINT) AS total_bytes,
       round(CAST(sum(size_bytes) OVER w AS DOUBLE) / CAST(sum(size_bytes) OVER () AS DOUBLE), 6) AS fraction
FROM manifest WHERE status IN ('copy', 'present') WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING)"""
ORACLES["commit_summary"] = f"""WITH {MANIFEST}
SELECT count(*) FILTER (WHERE status IN ('copy', 'present')) AS copied, count(*) FILTER (WHERE status = 'conflict') AS skipped,
       count(error) AS errors FROM manifest"""
ORACLES["commit_errors"] = f"WITH {MANIFEST} SELECT error FROM manifest WHERE error IS NOT NULL"

# --- scan --------------------------------------------------------------------------

FILES = r"""
listing AS (
  SELECT '/lib/' || CASE WHEN p_partkey % 50 = 0 THEN '.cache/' ELSE '' END || 'd' || ((p_partkey // 8) % 10) || '/img_'
           || CASE WHEN p_partkey % 8 = 5 THEN p_partkey - 5 ELSE p_partkey END
           || (['.jpg', '.JPEG', '.png', '.webp', '.txt', '.xmp', '', '.gif'])[p_partkey % 8 + 1] AS path,
         CAST(round(p_retailprice * 100) AS BIGINT) AS length,
         CAST(CASE WHEN p_partkey % 2 = 1 THEN 75 ELSE 100 END * p_size AS INTEGER) AS width,
         CAST(CASE WHEN p_partkey % 2 = 1 THEN 100 ELSE 75 END * p_size AS INTEGER) AS raw_height
  FROM part),
parts AS (
  SELECT *, CASE WHEN length % 13 = 0 THEN -1 ELSE raw_height END AS height,
         regexp_extract(path, '[^/]*$', 0) AS file_name,
         regexp_extract(regexp_extract(path, '[^/]*$', 0), '.(\.[^.]*)$', 1) AS extension,
         regexp_replace(path, '/[^/]*$', '') AS folder
  FROM listing),
named AS (
  SELECT *, substr(file_name, 1, length(file_name) - length(extension)) AS stem,
         lower(extension) IN ('.jpg', '.jpeg', '.png', '.webp', '.gif') AND NOT contains(path, '.cache') AS is_image
  FROM parts),
images AS (
  SELECT substr(path, 6) AS id, path AS absolute_path, file_name, width AS original_width, height AS original_height,
         length AS size_bytes, '/lib/.cache/res-768/' || stem || '_' || length || '.jpg' AS working_image_path
  FROM named WHERE is_image AND height > 0)"""
ORACLES["sidecars"] = f"""WITH {FILES}
SELECT s.path FROM named s WHERE lower(s.extension) IN ('.xmp', '.aae')
  AND EXISTS (SELECT 1 FROM named k WHERE k.folder = s.folder AND k.stem = s.stem
              AND lower(k.extension) IN ('.jpg', '.jpeg') AND NOT contains(k.path, '.cache'))"""
ORACLES["image_filter"] = f"WITH {FILES} SELECT path FROM named WHERE is_image"
ORACLES["path_parts"] = f"WITH {FILES} SELECT path, file_name, stem, extension, folder FROM named"
ORACLES["image_meta"] = f"WITH {FILES} SELECT * FROM images"
ORACLES["images_with_capture"] = f"""WITH {FILES}, {PHOTOS}
SELECT i.id, p.taken_unix_ms, round(p.latitude, 6) AS latitude, round(p.longitude, 6) AS longitude
FROM images i LEFT JOIN photos p ON i.id = 'd' || ((p.image_id // 8) % 10) || '/img_' || p.image_id || '.jpg'"""
ORACLES["scan_errors"] = f"""WITH {FILES}
SELECT substr(path, 6) || ': File corrupt or encoding format unsupported.' AS error FROM named WHERE is_image AND height <= 0"""
ORACLES["scan_summary"] = f"""WITH {FILES}
SELECT count(*) AS files_seen, count(*) FILTER (WHERE is_image) AS images_found,
       count(*) FILTER (WHERE NOT is_image) AS skipped_files, count(*) FILTER (WHERE is_image AND height > 0) AS images,
       count(*) FILTER (WHERE is_image AND height <= 0) AS errors FROM named"""
ORACLES["working_geometry"] = f"""WITH {FILES},
scaled AS (SELECT *, CASE WHEN greatest(original_width, original_height) > 768
  THEN CAST(768 AS DOUBLE) / greatest(original_width, original_height) ELSE CAST(1 AS DOUBLE) END AS scale FROM images)
SELECT id, original_width, original_height, CAST(trunc(original_width * scale) AS INTEGER) AS width,
       CAST(trunc(original_height * scale) AS INTEGER) AS height FROM scaled"""
ORACLES["working_name_collisions"] = f"""WITH {FILES}
SELECT stem || '_' || (length % 2) || '.jpg' AS name, count(*) AS files FROM named GROUP BY name HAVING count(*) > 1"""
ORACLES["pending_images"] = f"WITH {FILES} SELECT id FROM images WHERE id NOT LIKE '%.png'"
ORACLES["insert_new"] = f"""WITH {FILES},
batch AS (SELECT id, absolute_path, size_bytes AS seq FROM images UNION ALL
          SELECT id, '/copy' || absolute_path, 200000 - size_bytes FROM images)
SELECT id, arg_min(absolute_path, seq) AS absolute_path, min(seq) AS seq FROM batch
WHERE id NOT IN (SELECT id FROM images WHERE id LIKE '%.png') GROUP BY id"""
ORACLES["stored_paths"] = f"""WITH {FILES}
SELECT 'working' AS kind, working_image_path AS path FROM images WHERE size_bytes % 5 <> 0
UNION ALL SELECT 'original', absolute_path FROM images"""
VERDICTS = """
verdicts AS (
  SELECT CAST(floor(CAST(event_id AS DOUBLE) / 2 * CASE WHEN event_id % 50 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS image_id,
         CASE WHEN event_id % 40 = 0 THEN 2 ELSE CAST(event_id % 2 AS INTEGER) END AS is_junk,
         CASE WHEN event_id % 30 <> 0 THEN value END AS confidence FROM events),
survivors AS (SELECT p_partkey AS id FROM part)"""
ORACLES["constraint_audit"] = f"""WITH {VERDICTS},
bad AS (
  SELECT 'confidence is null' AS rule, image_id FROM verdicts WHERE confidence IS NULL
  UNION ALL SELECT 'is_junk out of domain', image_id FROM verdicts WHERE is_junk NOT IN (0, 1)
  UNION ALL SELECT 'image_id repeated', image_id FROM verdicts GROUP BY image_id HAVING count(*) > 1
  UNION ALL SELECT 'image_id has no parent', image_id FROM verdicts WHERE image_id NOT IN (SELECT id FROM survivors))
SELECT 'junk_flags' AS table_name, rule, CAST(image_id AS VARCHAR) AS row_key FROM bad"""
ORACLES["cascade_delete"] = f"WITH {VERDICTS} SELECT image_id, is_junk FROM verdicts WHERE image_id IN (SELECT id FROM survivors)"
ORACLES["session_state"] = """
SELECT event_type || '.' || user_id AS key, arg_max(props, event_id) AS value FROM events GROUP BY key"""
ORACLES["image_index"] = """
SELECT user_id AS id, min(event_id) AS first_seen, arg_max(event_type, event_id) AS event_type,
       arg_max(props, event_id) AS props FROM events GROUP BY user_id"""

# --- quality -----------------------------------------------------------------------

PIXELS = """
cells AS (
  SELECT vec_id AS image_id, CAST(u.pos AS BIGINT) - 1 AS pos, CAST(embedding[u.pos] AS DOUBLE) AS e
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS pos) u),
pixels AS (
  SELECT image_id, pos, pos // 8 AS r, pos % 8 AS c,
         CAST(greatest(0, least(255, floor(CAST(128 AS DOUBLE)
           + CAST(255 AS DOUBLE) * (CASE WHEN image_id % 5 = 4 THEN CAST(0.02 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) * e
           + CASE image_id % 4 WHEN 1 THEN CAST(-150 AS DOUBLE) WHEN 2 THEN CAST(150 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END))) AS INTEGER) AS v
  FROM cells)"""


def _metrics(low: int = 15, high: int = 240, passing: str = "0.70", cells: int = 2, readable: str = "true") -> str:
    return PIXELS + f""",
weighted AS (
  SELECT *, CASE WHEN v <= {low} THEN pow(({low}.0 - v) / {low}, 2) ELSE 0 END AS s,
         CASE WHEN v >= {high} THEN pow((v - {high}.0) / (255 - {high}), 2) ELSE 0 END AS h,
         CASE WHEN r < 6 AND c < 6 THEN (r // 2) * 3 + c // 2 END AS cell,
         coalesce(lag(v) OVER down, lead(v) OVER down) + coalesce(lead(v) OVER down, lag(v) OVER down)
           + coalesce(lag(v) OVER across, lead(v) OVER across) + coalesce(lead(v) OVER across, lag(v) OVER across)
           - 4 * v AS lap
  FROM pixels WHERE {readable}
  WINDOW down AS (PARTITION BY image_id, c ORDER BY r), across AS (PARTITION BY image_id, r ORDER BY c)),
per_cell AS (SELECT image_id, cell, avg(s) AS under, avg(h) AS over FROM weighted WHERE cell IS NOT NULL GROUP BY image_id, cell),
good AS (SELECT image_id, count(*) FILTER (WHERE under < {passing} AND over < {passing}) AS good_cells FROM per_cell GROUP BY image_id),
measured AS (
  SELECT image_id, true AS valid, (sum(lap * lap) - CAST(sum(lap) AS DOUBLE) * sum(lap) / count(*)) / count(*) AS sharpness, avg(s) AS raw_under, avg(h) AS over
  FROM weighted GROUP BY image_id),
metrics AS (
  SELECT m.*, g.good_cells, CASE WHEN g.good_cells >= {cells} THEN 0 ELSE raw_under END AS under
  FROM measured m JOIN good g USING (image_id))"""


def _judged(blur: int = 100, **limits) -> str:
    return _metrics(**limits) + f""",
everything AS (
  SELECT e.vec_id AS image_id, coalesce(valid, false) AS valid, coalesce(sharpness, 0) AS sharpness, raw_under, under, over,
         coalesce(good_cells, 0) AS good_cells
  FROM embeddings e LEFT JOIN metrics m ON e.vec_id = m.image_id),
judged AS (
  SELECT *, concat_ws(',', CASE WHEN valid AND sharpness < {blur} THEN 'BLURRY' END,
                      CASE WHEN valid AND under > 0.3 THEN 'UNDER_EXPOSED' END,
                      CASE WHEN valid AND over > 0.3 THEN 'OVER_EXPOSED' END,
                      CASE WHEN NOT valid THEN 'UNREADABLE' END) AS reasons,
         CASE WHEN valid THEN greatest(0, least(1, 0.5 + 0.5 * (over - under))) END AS exposure_score
  FROM everything)"""


_SEEN = "image_id % 31 <> 30"
ORACLES["luminance"] = f"""WITH {PIXELS}
SELECT image_id, pos, CAST((vs[pos + 1] * 299 + vs[(pos + 21) % 64 + 1] * 587 + vs[(pos + 42) % 64 + 1] * 114 + 500) // 1000 AS INTEGER) AS v
FROM (SELECT image_id, list(v ORDER BY pos) AS vs FROM pixels GROUP BY image_id), (SELECT unnest(generate_series(0, 63)) AS pos)"""
ORACLES["level_histogram"] = f"WITH {PIXELS} SELECT image_id, v, count(*) AS n FROM pixels GROUP BY image_id, v"
ORACLES["cell_clipping"] = f"""WITH {_metrics()}
SELECT image_id, CAST(cell AS INTEGER) AS cell, round(under, 6) AS under, round(over, 6) AS over FROM per_cell"""
ORACLES["quality_metrics"] = f"""WITH {_judged(readable=_SEEN)}
SELECT image_id, valid, sharpness, round(raw_under, 6) AS raw_under, round(under, 6) AS under,
       round(over, 6) AS over, CAST(good_cells AS INTEGER) AS good_cells FROM judged"""
ORACLES["quality_flags"] = f"""WITH {_judged(readable=_SEEN)}
SELECT image_id, reasons, sharpness, round(exposure_score, 9) AS exposure_score
FROM judged WHERE reasons <> ''"""
ORACLES["quality_reason_labels"] = f"""WITH {_judged(readable=_SEEN)}
SELECT image_id, replace(replace(replace(replace(reasons, 'BLURRY', 'Blurry'), 'UNDER_EXPOSED', 'Underexposed'),
                         'OVER_EXPOSED', 'Overexposed'), 'UNREADABLE', 'Unreadable') AS labels
FROM judged WHERE reasons <> ''"""
ORACLES["quality_summary"] = f"WITH {_judged(readable=_SEEN)} SELECT count(*) FILTER (WHERE reasons <> '') AS flagged, count(*) AS total FROM judged"
ORACLES["low_quality_images"] = f"WITH {_judged(readable=_SEEN)} SELECT image_id FROM judged WHERE reasons <> '' ORDER BY image_id"
ORACLES["quality_strict_limits"] = f"""WITH {_judged(blur=5000, low=40, high=200, passing='0.5', cells=4)}
SELECT image_id, CAST(good_cells AS INTEGER) AS good_cells, reasons FROM judged"""
ORACLES["luma_contrast"] = f"""WITH {PIXELS},
counts AS (SELECT image_id, v, count(*) / 64.0 AS p FROM pixels GROUP BY image_id, v)
SELECT image_id, round(abs(sum(p * ln(p)) / ln(256)), 9) AS contrast FROM counts GROUP BY image_id"""

# --- junk -------------------------------------------------------------------------------

JUNK = PIXELS + """,
blocks AS (SELECT image_id, r // 2 AS br, c // 2 AS bc, min(v) = max(v) AS flat FROM pixels GROUP BY ALL),
flat AS (SELECT image_id, avg(CASE WHEN flat THEN 1 ELSE 0 END) AS flat_ratio FROM blocks GROUP BY image_id),
few AS (SELECT image_id, count(DISTINCT v) / 64.0 AS unique_ratio FROM pixels GROUP BY image_id),
steps AS (
  SELECT image_id, r, c, abs(lead(v) OVER (PARTITION BY image_id, c ORDER BY r) - v) >= 32 AS below,
         abs(lead(v) OVER (PARTITION BY image_id, r ORDER BY c) - v) >= 32 AS beside FROM pixels),
lines AS (
  SELECT image_id, 'h' AS kind, r AS line, avg(CASE WHEN below THEN 1 ELSE 0 END) >= 0.75 AS straight FROM steps WHERE r < 7 GROUP BY ALL
  UNION ALL
  SELECT image_id, 'v', c, avg(CASE WHEN beside THEN 1 ELSE 0 END) >= 0.75 FROM steps WHERE c < 7 GROUP BY ALL),
edges AS (SELECT image_id, avg(CASE WHEN straight THEN 1 ELSE 0 END) AS straight_ratio FROM lines GROUP BY image_id),
features AS (SELECT * FROM few JOIN flat USING (image_id) JOIN edges USING (image_id)),
votes AS (
  SELECT *, CASE WHEN flat_ratio >= 0.25 THEN 1 ELSE 0 END + CASE WHEN unique_ratio <= 0.5 THEN 1 ELSE 0 END
            + CASE WHEN straight_ratio >= 0.2 THEN 1 ELSE 0 END AS n
  FROM features)"""
ORACLES["junk_features"] = f"""WITH {JUNK}
SELECT image_id, round(flat_ratio, 6) AS flat_ratio, round(CAST(unique_ratio AS DOUBLE), 6) AS unique_ratio,
       round(straight_ratio, 6) AS straight_ratio FROM features"""
ORACLES["junk_flags"] = f"""WITH {JUNK}
SELECT image_id, CASE WHEN straight_ratio >= 0.2 THEN 'screenshot' ELSE 'non-photograph' END AS reason,
       round(n / CAST(3 AS DOUBLE), 6) AS confidence FROM votes WHERE n >= 2"""
ORACLES["junk_summary"] = f"WITH {JUNK} SELECT count(*) FILTER (WHERE n >= 2) AS flagged, count(*) AS total FROM votes"
ORACLES["junk_unjudged"] = f"""WITH {JUNK}
SELECT image_id, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS is_junk,
       CASE WHEN n < 2 THEN NULL WHEN straight_ratio >= 0.2 THEN 'screenshot' ELSE 'non-photograph' END AS reason,
       round(CASE WHEN n >= 2 THEN n ELSE 3 - n END / CAST(3 AS DOUBLE), 6) AS confidence
FROM votes WHERE image_id NOT IN (SELECT doc_id FROM labels)"""
ORACLES["junk_by_model"] = f"""WITH {PIXELS}, means AS (SELECT image_id, avg(v) AS m FROM pixels GROUP BY image_id)
SELECT image_id, CASE WHEN m < 40 THEN 1 ELSE 0 END AS is_junk, CASE WHEN m < 40 THEN 'scan' END AS reason,
       round(1 - m / 255, 6) AS confidence FROM means"""

# --- features ----------------------------------------------------------------------------

SHRUNK = PIXELS + """,
overlap AS (
  SELECT image_id, r AS ty, t AS tx, v, least((c + 1) * 9, (t + 1) * 8) - greatest(c * 9, t * 8) AS part
  FROM pixels, (SELECT unnest(generate_series(0, 8)) AS t)),
shrunk AS (
  SELECT image_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx,
         CAST((2 * sum(v * part) + 8) // 16 AS INTEGER) AS level
  FROM overlap WHERE part > 0 GROUP BY image_id, ty, tx),
compared AS (
  SELECT image_id, ty * 8 + tx AS bit, level > lead(level) OVER (PARTITION BY image_id, ty ORDER BY tx) AS brighter, tx FROM shrunk)"""
ORACLES["shrunken_levels"] = f"WITH {SHRUNK} SELECT image_id, ty, tx, level FROM shrunk"
ORACLES["dhash"] = f"""WITH {SHRUNK}
SELECT image_id, CAST(coalesce(sum(1::BIGINT << (bit % 32)) FILTER (WHERE brighter AND bit < 32), 0) AS BIGINT) AS low_bits,
       CAST(coalesce(sum(1::BIGINT << (bit % 32)) FILTER (WHERE brighter AND bit >= 32), 0) AS BIGINT) AS high_bits
FROM compared WHERE tx < 8 GROUP BY image_id"""
COLOURS = PIXELS + """,
rgb AS (
  SELECT p.image_id, p.v AS r, g.v AS g, b.v AS b,
         greatest(p.v, g.v, b.v) AS hi, greatest(p.v, g.v, b.v) - least(p.v, g.v, b.v) AS d
  FROM pixels p JOIN pixels g ON g.image_id = p.image_id AND g.pos = (p.pos + 21) % 64
                JOIN pixels b ON b.image_id = p.image_id AND b.pos = (p.pos + 42) % 64),
hs AS (
  SELECT image_id,
         CASE WHEN d = 0 THEN 0 ELSE
           (CAST(CASE WHEN hi = r THEN floor((60.0 * (g - b) + d) / (2 * d))
                      WHEN hi = g THEN floor((60.0 * (b - r) + d) / (2 * d)) + 60
                      ELSE floor((60.0 * (r - g) + d) / (2 * d)) + 120 END AS INTEGER) + 180) % 180 END AS hue,
         CASE WHEN hi = 0 THEN 0 ELSE (510 * d + hi) // (2 * hi) END AS sat
  FROM rgb),
bins AS (
  SELECT image_id, CAST(hue * 50 // 180 AS INTEGER) AS h_bin, CAST(sat * 60 // 256 AS INTEGER) AS s_bin, count(*) AS n
  FROM hs GROUP BY ALL)"""
ORACLES["colour_bins"] = f"WITH {COLOURS} SELECT image_id, h_bin, s_bin, n FROM bins"
ORACLES["colour_histogram"] = f"""WITH {COLOURS}
SELECT image_id, h_bin * 60 + s_bin AS bin, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY image_id), 6) AS level FROM bins"""

# --- similar groups -----------------------------------------------------------------------

BURSTS = """
xs AS (
  SELECT vec_id * 3 + k AS image_id, pos,
         CAST(embedding[pos + 1] AS DOUBLE) + (CASE WHEN vec_id % 3 = 0 THEN CAST(0.04 AS DOUBLE) ELSE CAST(0.002 AS DOUBLE) END)
           * k * ((pos * 7 + k * 13) % 5 - 2) AS x
  FROM embeddings, (SELECT unnest(generate_series(0, 2)) AS k), (SELECT unnest(generate_series(0, 63)) AS pos)),
bits AS (SELECT image_id, pos, x > lead(x) OVER (PARTITION BY image_id ORDER BY pos) AS up FROM xs),
hashes AS (SELECT image_id, CAST(coalesce(sum(1::BIGINT << pos) FILTER (WHERE up), 0) AS BIGINT) AS h FROM bits WHERE pos < 63 GROUP BY image_id),
close AS (
  SELECT a.image_id AS a, b.image_id AS b, bit_count(xor(a.h, b.h)) AS hamming
  FROM hashes a JOIN hashes b ON a.image_id < b.image_id WHERE bit_count(xor(a.h, b.h)) <= 16),
scored AS (
  SELECT c.a, c.b, c.hamming, 1 - least(1, greatest(-1, corr(xa.x, xb.x))) AS hist
  FROM close c JOIN xs xa ON xa.image_id = c.a JOIN xs xb ON xb.image_id = c.b AND xb.pos = xa.pos GROUP BY ALL),
near AS (SELECT a, b, hamming, hist, 0.4 * hist + 0.6 * hamming / 64 AS distance FROM scored WHERE 0.4 * hist + 0.6 * hamming / 64 <= 0.15),
seats AS (
  SELECT image_id, row_number() OVER (ORDER BY image_id) AS seat,
         coalesce((SELECT list(a) FROM near WHERE b = image_id), []) AS earlier FROM hashes),
walk(seat, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT s.seat, CASE WHEN list_has_any(w.leaders, s.earlier) THEN w.leaders ELSE list_append(w.leaders, s.image_id) END
  FROM walk w JOIN seats s ON s.seat = w.seat + 1),
chosen AS (SELECT unnest(leaders) AS leader FROM walk WHERE seat = (SELECT max(seat) FROM walk)),
assigned AS (
  SELECT image_id, coalesce((SELECT min(a) FROM near JOIN chosen ON a = leader WHERE b = image_id), image_id) AS leader_id FROM hashes),
sizes AS (SELECT leader_id, count(*) AS size, row_number() OVER (ORDER BY leader_id) - 1 AS raw_group_idx FROM assigned GROUP BY leader_id),
grouped AS (SELECT *, row_number() OVER (ORDER BY leader_id) AS group_id FROM sizes WHERE size >= 2),
rated AS (
  SELECT h.image_id, 100.0 + e.vec_id % 50 - 3 * ((h.image_id % 3 + e.label) % 3) AS sharpness, (h.image_id % 3 * 2 + 1) / CAST(7 AS DOUBLE) AS contrast,
         CASE WHEN e.vec_id % 4 = 0 THEN h.image_id % 3 / CAST(4 AS DOUBLE) END AS face
  FROM hashes h JOIN embeddings e ON e.vec_id = h.image_id // 3),
scores AS (
  SELECT g.group_id, image_id, (0.6 * sharpness / max(sharpness) OVER (PARTITION BY g.group_id) + 0.4 * contrast
           + CASE WHEN face IS NULL THEN 0 ELSE 0.5 * face END) / CASE WHEN face IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS score
  FROM assigned JOIN grouped g USING (leader_id) JOIN rated USING (image_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(score, 12) DESC, image_id) AS rank FROM scores)"""
_GREEDY = f"WITH RECURSIVE {BURSTS}"
ORACLES["similar_search"] = f"""{_GREEDY}
SELECT a AS target_id, b AS image_id, CAST(hamming AS INTEGER) AS hamming, round(distance, 6) AS distance FROM near WHERE a % 100 = 0
UNION ALL SELECT b, a, CAST(hamming AS INTEGER), round(distance, 6) FROM near WHERE b % 100 = 0"""
ORACLES["similar_leaders"] = f"{_GREEDY} SELECT image_id, leader_id FROM assigned"
ORACLES["leader_distances"] = f"""{_GREEDY}
SELECT g.image_id, leader_id, CAST(coalesce(hamming, 0) AS INTEGER) AS hamming, round(coalesce(hist, 0), 6) AS hist_distance,
       round(coalesce(distance, 0), 6) AS distance
FROM assigned g LEFT JOIN near ON a = leader_id AND b = image_id"""
ORACLES["similar_groups"] = f"{_GREEDY} SELECT group_id, raw_group_idx, leader_id, size FROM grouped"
ORACLES["group_members_ranked"] = f"{_GREEDY} SELECT group_id, rank, image_id, round(score, 6) AS score, rank = 1 AS is_keeper FROM ranked"
ORACLES["recommended_keepers"] = f"{_GREEDY} SELECT group_id, image_id AS recommended_id FROM ranked WHERE rank = 1"
ORACLES["group_member_arrays"] = f"""{_GREEDY}
SELECT group_id, CAST(0 AS BIGINT) AS chunk_no, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY rank) AS image_ids,
       string_agg(printf('%.6f', score), ',' ORDER BY rank) AS member_scores FROM ranked GROUP BY group_id"""
ORACLES["similar_summary"] = f"{_GREEDY} SELECT count(*) AS groups, CAST(sum(size) AS BIGINT) AS total_images FROM grouped"

# --- streams ---------------------------------------------------------------------------------

ORACLES["stream_decisions"] = ORACLES["user_decisions"]
ORACLES["stream_keepers"] = ORACLES["group_keepers"]
ORACLES["stream_index"] = ORACLES["image_index"]
ORACLES["stream_split"] = """
SELECT 'progress' AS kind, event_id AS seq, event_id || '|' || user_id AS payload FROM events WHERE event_type = 'view'
UNION ALL SELECT 'row', event_id, user_id || '|' || props FROM events WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT 'complete', event_id, user_id || '|' || event_id FROM events WHERE event_type = 'signup'"""
ORACLES["stream_without_repeats"] = "SELECT DISTINCT user_id % 40 AS id FROM events"
# A session is closed once its last photo is more than the gap before the watermark.
ORACLES["stream_trips"] = f"""WITH {_assigned('owner', 12, 300)},
sessions AS (
  SELECT *, sum(CASE WHEN pt IS NULL OR gap_ms > 12 * 3600000 THEN 1 ELSE 0 END)
              OVER (PARTITION BY owner ORDER BY taken_unix_ms, image_id ROWS UNBOUNDED PRECEDING) AS session_no FROM assigned),
closed AS (
  SELECT owner, session_no FROM sessions GROUP BY owner, session_no
  HAVING max(taken_unix_ms) + 12 * 3600000 <= (SELECT max(taken_unix_ms) FROM photos) - 3600000)
SELECT owner, min(taken_unix_ms) AS start_unix_ms, max(taken_unix_ms) AS end_unix_ms, count(*) AS photos,
       round(avg(latitude), 6) AS centroid_lat, round(avg(longitude), 6) AS centroid_lon
FROM sessions JOIN closed USING (owner, session_no) GROUP BY owner, trip_id"""
ORACLES["stream_trips_closed"] = f"WITH {_assigned('owner', 12, 300)} SELECT owner, {_TRIP_COLUMNS} FROM assigned GROUP BY owner, trip_id"

# Pictures are 8 x 8 points of three bytes, uncompressed: 268 bytes a file. A file that is no picture has 6.
_FILES = """
named AS (
  SELECT vec_id, (vec_id % 10) || '/' || CASE vec_id % 7 WHEN 0 THEN '_DSC' WHEN 1 THEN '.h' ELSE 'img' END || vec_id AS stem FROM embeddings),
files AS (
  SELECT vec_id, stem || CASE WHEN vec_id % 11 = 0 THEN '.JPG' ELSE '.png' END AS id, CAST(CASE WHEN vec_id % 11 = 0 THEN 6 ELSE 268 END AS BIGINT) AS length, TRUE AS picture FROM named
  UNION ALL SELECT vec_id, stem || '.xmp', 4, FALSE FROM named WHERE vec_id % 5 = 0)"""
ORACLES["folder_listing"] = f"WITH {_FILES} SELECT id, length, picture FROM files"
ORACLES["folder_stream"] = f"WITH {_FILES} SELECT id, length FROM files WHERE picture"
ORACLES["folder_pictures"] = f"""WITH {_FILES}, {PIXELS},
light AS (SELECT image_id, 3 * sum(v)::BIGINT AS light FROM pixels GROUP BY image_id)
SELECT id, CASE WHEN length > 6 THEN 8 END AS width, CASE WHEN length > 6 THEN 8 END AS height, CASE WHEN length > 6 THEN light END AS light
FROM files JOIN light ON image_id = vec_id WHERE picture"""
ORACLES["library_resumed"] = """
SELECT step, step = 1 AS resumed_session, n AS images, n AS stamped
FROM (SELECT unnest([0, 1, 2]) AS step), (SELECT count(*) AS n FROM embeddings)"""
ORACLES["junk_stored"] = ORACLES["junk_flags"]
ORACLES["copied_files"] = f"WITH {_FILES} SELECT id, 'copied' AS first_run, 'present' AS second_run, length FROM files"
# Late photos end in the trips they belong to, as if they had come in time.
ORACLES["stream_trips_late"] = ORACLES["stream_trips_closed"]
