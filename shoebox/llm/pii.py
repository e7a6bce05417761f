"""Personal data by weak supervision: labelers vote on spans, EM weighs the labelers, a classifier decides.

DataFrame functions only. In one pass over the texts every row gets its base spans (strict patterns and checks) and its
candidates: all matches of the base patterns, also failing ones, and matches of loose patterns (written-out
addresses, numbers without country code, unusual separators). Six labelers vote on a candidate:

- strict pattern, and check (Luhn, digit counts, ranges, endings): from the match itself;
- gazetteer: address endings, issuer prefixes, country codes, ranges of addresses that are in use;
- context: words before the match that announce, or speak against, this kind;
- surroundings: is it glued to letters or digits; variety: is it made of one or two symbols.

The votes of all documents are counted by pattern (at most 4 x 3^6 of them, whatever the input). Expectation-maximisation
over these counts estimates how often each labeler votes how on true and on false spans of a kind. Its
probabilities are the labels on which a logistic regression over the features of a candidate is fitted. Loose candidates
that it accepts, and that overlap no base span, are added. Base spans always stay.

Defined results: null texts are empty. Positions count code points from 0, ends are exclusive. Rows that repeat give a row
each. Without candidates nothing is fitted and nothing added. Other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut

KINDS = ("email", "ip", "card", "phone")

# The four given patterns. Look-behinds only skip places within a run of symbols where a match would have begun
# before, and groups do not give back, as nothing follows them: long runs then take linear time and no deep stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without this symbol have no match.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}

LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+"
    r"(?:\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?|\x20(?i:dot)\x20|\.)[A-Za-z0-9-]{2,63}+){1,4}+"
    r"|\x20(?i:at)\x20[A-Za-z0-9-]{1,63}+(?:\x20(?i:dot)\x20[A-Za-z0-9-]{2,63}+){1,4}+)",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}+|(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4})",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[./_ –‑\x20-]{1,3}[0-9]{4,6}[./_ –‑\x20-]{1,3}[0-9]{4,5}(?:[./_ –‑\x20-]{1,3}[0-9]{1,7})?+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])(?:00[1-9][0-9]{0,2}(?:[\x20./-]{1,2}(?:\(0\)\x20?)?[0-9]{2,5}){2,5}+"
    r"|(?:\(0?[0-9]{2,4}\)[\x20./-]{0,2}|0?[0-9]{2,4}[\x20./-]{1,2})[0-9]{3,4}[\x20./-]{1,2}[0-9]{2,5}(?:[\x20./-][0-9]{2,4})?+)(?!\.?[0-9A-Za-z])",
}
_ANY_LOOSE = "|".join(LOOSE.values())

# Address endings, calling codes and issuer prefixes in common use.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|io|dev|app|de|at|ch|fr|be|es|mx|ar|it|pt|br|nl|uk|ie|us|ca|au|nz|eu|pl|cz|se|no|fi|dk|ru|jp|cn|in|kr|za"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|852|886|97[0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[4578]|6011|64[4-9]|65|62|50|5[6-9]|6[0-9]"
# Words that announce a kind, in the languages of the corpus, and words that speak against all of them.
CUES = {
    "email": "e-?mails?|mail|courriel|correo|write to|contact|kontakt|contacto|reach|schreib\\w*",
    "ip": "ip|ipv[46]|host|server|address|adresse|dirección|gateway|login from",
    "card": "cards?|credit|debit|visa|mastercard|amex|kreditkarte|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|fax|mobile|cell|telefon|handy|anruf\\w*|téléphone|appel\\w*|teléfono|móvil|llam\\w*",
}
AGAINST = "version|release|build|isbn|issn|doi|order|invoice|ticket|article|section|chapter|page|figure|serial|part|sku|model|rfc|bestellung|rechnung|seite|página|commande"

LEFT, RIGHT = 40, 1
_BLOCK = 256

# Features of a candidate, one bit each.
FEATURES = ("loose", "valid", "listed", "unlisted", "cue", "against", "glued", "uniform")
_BIT = {name: 1 << i for i, name in enumerate(FEATURES)}


@dataclass(frozen=True)
class Fit:
    """Rounds of EM, pseudo-counts of a labeler's right and wrong votes, the least probability that adds a span, and the regression's penalty."""

    rounds: int = 25
    right: float = 6.0
    wrong: float = 1.0
    least: float = 0.5
    penalty: float = 0.01


def _scan(items: Column, first: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of what ``step(state, item)`` gives out (second) while it hands a long on (first); ``kind`` is its type.

    Works in blocks: appending to one array of all entries would copy it once an entry.
    """

    def block(state: Column, number: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def add(acc: Column, item: Column) -> Column:
            following, out = step(acc["at"], item)
            return F.struct(following.alias("at"), F.concat(acc["out"], F.array(out.cast(kind))).alias("out"))

        inner = F.aggregate(F.slice(items, number * _BLOCK + 1, F.lit(_BLOCK)), start, add)
        return F.aggregate(
            F.array(inner), state, lambda s, x: F.struct(x["at"].alias("at"), F.concat(s["out"], F.array(x["out"])).alias("out"))
        )

    begin = F.struct(first.cast("long").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
    scanned = F.aggregate(numbers, begin, block, lambda s: F.flatten(s["out"]))
    return F.when(F.size(items) > 0, scanned).otherwise(F.array().cast(f"array<{kind}>"))


_HIT = "struct<start:long,stop:long,hit:string,before:string,after:string>"


def _with_hits(rows: DataFrame, name: str, pattern: str, needed: str | None) -> DataFrame:
    """Add ``name``: the leftmost non-overlapping matches in ``t`` with their places and surroundings."""
    none = F.array().cast("array<string>")
    may = F.contains("t", F.lit(needed)) if needed else F.lit(True)
    rows = rows.withColumn("_parts", F.when(may, F.split("t", pattern, -1)).otherwise(none))
    rows = rows.withColumn("_hits", F.when(F.size("_parts") > 1, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    items = F.transform(
        "_hits",
        lambda hit, i: F.struct(
            F.length(F.get("_parts", i)).cast("long").alias("gap"),
            hit.alias("hit"),
            F.right(F.get("_parts", i), F.lit(LEFT)).alias("before"),
            F.left(F.get("_parts", i + 1), F.lit(RIGHT)).alias("after"),
        ),
    )
    rows = rows.withColumn("_items", items)

    def place(at: Column, item: Column) -> tuple[Column, Column]:
        start = at + item["gap"]
        stop = start + F.length(item["hit"])
        return stop, F.struct(start.alias("start"), stop.alias("stop"), item["hit"].alias("hit"), item["before"].alias("before"), item["after"].alias("after"))

    return rows.withColumn(name, _scan(F.col("_items"), F.lit(0), _HIT, place)).drop("_parts", "_hits", "_items")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


_OCTET = r"0*+(?:(?<=0)|25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)"
_FOUR = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _passes(kind: str, hit: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return hit.rlike(_FOUR)
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _written(hit: Column) -> Column:
    """A loosely written address in its usual form."""
    dots = F.regexp_replace(hit, r"\x20?[\[({]\x20?(?:(?i:dot)|\.)\x20?[\])}]\x20?|\x20(?i:dot)\x20", ".")
    return F.regexp_replace(dots, r"\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20(?i:at)\x20", "@")


def _features(kind: str, loose: bool, hit: Column, before: Column, after: Column) -> Column:
    """The features of a match, as bits."""
    digits = _digits(hit)
    if kind == "email":
        form = _written(hit)
        valid = form.rlike(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
        listed, unlisted = form.rlike(rf"(?i)\.(?:{ENDINGS})$"), ~form.rlike(rf"(?i)\.(?:{ENDINGS})$")
        symbols = F.lower(F.regexp_replace(hit, "[^A-Za-z0-9]", ""))
    elif kind == "ip":
        form = _written(hit)
        valid = form.rlike(_FOUR) | (form.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") & form.rlike("[A-Fa-f]"))
        listed, unlisted = form.rlike(r"^(?:[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), form.rlike(r"^0*[0-9]\.")
        symbols = F.lower(F.regexp_replace(hit, "[^A-Fa-f0-9]", ""))
    elif kind == "card":
        valid = _luhn(digits)
        listed, unlisted = digits.rlike(rf"^(?:{ISSUERS})"), ~digits.rlike(rf"^(?:{ISSUERS})")
        symbols = digits
    else:
        valid = F.length(digits).between(9, 15)
        listed = hit.rlike(rf"^(?:\+|00)\x20?\(?(?:{CALLING})") | hit.rlike(r"^\(")
        unlisted = ~listed & ~hit.rlike("^0[1-9]")
        symbols = digits
    said = F.lower(before)
    bits = {
        "loose": F.lit(loose),
        "valid": valid,
        "listed": listed,
        "unlisted": unlisted,
        "cue": said.rlike(rf"(?U)(?<!\w)(?:{CUES[kind]})(?!\w)"),
        "against": said.rlike(rf"(?U)(?<!\w)(?:{AGAINST})(?!\w)"),
        "glued": before.rlike(r"(?U)[\w@#=]$") | after.rlike(r"(?U)^[\w@]"),
        # Whole texts of one or two symbols, such as rows of zeros.
        "uniform": symbols.rlike(r"^(.)\1*+(?:(.)(?:\1|\2)*+)?$"),
    }
    total = F.lit(0)
    for name, held in bits.items():
        total = total + F.when(held, _BIT[name]).otherwise(0)
    return total.cast("int")


_SPAN = "struct<start:long,stop:long>"
_CANDIDATE = "struct<kind:string,start:long,stop:long,bits:int>"


def _free_of(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base span; both are ordered by start."""
    far = 1 << 62
    marked = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit("").alias("kind"), F.lit(0).alias("bits"))),
        F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["bits"].alias("bits"))),
    )
    entry = "struct<start:long,stop:long,kind:string,bits:int,free:boolean>"

    def from_left(reach: Column, s: Column) -> tuple[Column, Column]:
        # Base spans that begin with or before a candidate come first.
        return F.when(s["kind"] == "", F.greatest(reach, s["stop"])).otherwise(reach), F.struct(s["start"], s["stop"], s["kind"], s["bits"], (reach <= s["start"]).alias("free"))

    def from_right(reach: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["kind"] == "", F.least(reach, s["start"])).otherwise(reach), F.struct(s["start"], s["stop"], s["kind"], s["bits"], (s["free"] & (reach >= s["stop"])).alias("free"))

    forward = _scan(F.sort_array(marked), F.lit(0), entry, from_left)
    both = _scan(F.reverse(forward), F.lit(far), entry, from_right)
    kept = F.filter(F.reverse(both), lambda s: (s["kind"] != "") & s["free"])
    freed = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["bits"].alias("bits")))
    return F.when(F.size(candidates) == 0, F.array().cast(f"array<{_CANDIDATE}>")).when(F.size(base) == 0, candidates).otherwise(freed)


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: ``id``, base spans by kind, ``seen`` (features of base matches) and ``open`` (loose candidates)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for kind in KINDS:
        rows = _with_hits(rows, f"_{kind}", BASE[kind], NEEDED.get(kind))
    rows = _with_hits(rows, "_loose", _ANY_LOOSE, None).drop("t")

    def seen(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda h: F.struct(F.lit(kind).alias("kind"), _features(kind, False, h["hit"], h["before"], h["after"]).alias("bits")))

    def kind_of(hit: Column) -> Column:
        named = F.when(hit.rlike("(?i)at"), "email").when(hit.rlike(r"[\[(:]") & hit.rlike(rf"^(?:{LOOSE['ip']})$"), "ip")
        return named.when(hit.rlike(rf"^(?:{LOOSE['card']})$"), "card").otherwise("phone")

    def candidate(h: Column) -> Column:
        bits = F.lit(0)
        kind = kind_of(h["hit"])
        for name in reversed(KINDS):
            bits = F.when(kind == name, _features(name, True, h["hit"], h["before"], h["after"])).otherwise(bits)
        return F.struct(kind.alias("kind"), h["start"].alias("start"), h["stop"].alias("stop"), bits.cast("int").alias("bits"))

    rows = rows.withColumn("_all", F.transform("_loose", candidate))
    for kind in KINDS:
        spans = F.transform(F.filter(f"_{kind}", lambda h: _passes(kind, h["hit"])), lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("stop")))
        rows = rows.withColumn(kind, spans)
    base = F.concat(*KINDS)
    return rows.select("id", *KINDS, F.concat(*[seen(k) for k in KINDS]).alias("seen"), _free_of(F.col("_all"), base).alias("open"))


def votes(bits: int) -> tuple[int, ...]:
    """What the labelers say: 1 for personal data, -1 against, 0 for nothing."""
    has = {name: bool(bits & _BIT[name]) for name in FEATURES}
    strict = 0 if has["loose"] else 1 if has["valid"] else -1
    check = 1 if has["valid"] else -1
    gazetteer = has["listed"] - has["unlisted"]
    context = has["cue"] - has["against"]
    around = -1 if has["glued"] else 1
    variety = -1 if has["uniform"] else 0
    return strict, check, gazetteer, context, around, variety


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], how: Fit = Fit()) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that a candidate with these votes is personal data, by EM over counted vote patterns.

    Labelers are taken as independent given the truth; each kind has its own share of true spans, and each labeler its own
    chances of being right on true and on false spans of that kind; one that says nothing tells nothing. Pseudo-counts keep
    them the right way round.
    """
    found: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _ in counts}):
        rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        total = sum(n for _, n in rows)
        chance = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v, _ in rows}
        for _ in range(how.rounds):
            true = sum(n * chance[v] for v, n in rows)
            share = (true + 1) / (total + 2)
            tables = []
            for labeler in range(len(rows[0][0])):
                for truth in (1, -1):
                    table = {truth: how.right, -truth: how.wrong}
                    for v, n in rows:
                        if v[labeler]:
                            table[v[labeler]] += n * (chance[v] if truth == 1 else 1 - chance[v])
                    scale = sum(table.values())
                    tables.append((labeler, truth, {vote: x / scale for vote, x in table.items()}))
            for v, _ in rows:
                odds = math.log(share) - math.log(1 - share)
                for labeler, truth, table in tables:
                    if v[labeler]:
                        odds += truth * math.log(table[v[labeler]])
                chance[v] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        found |= {(kind, v): chance[v] for v, _ in rows}
    return found


def _inputs(kind: Column, bits: Column) -> list[Column]:
    """The regression's inputs: the features of each kind apart."""
    of_kind = [(kind == k).cast("double") for k in KINDS]
    parts = [F.when(bits.bitwiseAND(_BIT[name]) != 0, 1.0).otherwise(0.0) for name in FEATURES]
    return of_kind + parts + [k * p for k in of_kind for p in parts]


def fitted(found: DataFrame, how: Fit = Fit()) -> list[float] | None:
    """Intercept and weights of the span classifier, or none where there is nothing to learn from."""
    pairs = F.concat("seen", F.transform("open", lambda s: F.struct(s["kind"].alias("kind"), s["bits"].alias("bits"))))
    spans = found.select(F.explode(pairs).alias("s")).select("s.kind", "s.bits")
    # At most 4 x 2^8 patterns of features.
    patterns = spans.groupBy("kind", "bits").agg(F.count(F.lit(1)).alias("n")).collect()
    if not patterns:
        return None
    counts: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in patterns:
        key = (r.kind, votes(r.bits))
        counts[key] = counts.get(key, 0) + r.n
    chance = reliabilities(counts, how)
    rows = []
    for r in sorted(patterns, key=lambda r: (r.kind, r.bits)):
        p = min(1 - 1e-6, max(1e-6, chance[r.kind, votes(r.bits)]))
        # The logarithm keeps common numbers from outvoting rare forms.
        weight = 1 + math.log(r.n)
        rows += [(r.kind, r.bits, 1.0, weight * p), (r.kind, r.bits, 0.0, weight * (1 - p))]
    entries = [dict(zip(("kind", "bits", "label", "weight"), r)) for r in rows]
    table = F.from_json(F.lit(json.dumps(entries)), "array<struct<kind:string,bits:int,label:double,weight:double>>")
    labelled = found.sparkSession.range(1).coalesce(1).select(F.inline(table))
    inputs = [c.alias(f"f{i}") for i, c in enumerate(_inputs(F.col("kind"), F.col("bits")))]
    wide = VectorAssembler(inputCols=[f"f{i}" for i in range(len(inputs))], outputCol="features").transform(labelled.select("label", "weight", *inputs))
    model = LogisticRegression(weightCol="weight", regParam=how.penalty, maxIter=60, standardization=False).fit(wide.select("label", "weight", "features"))
    return [float(model.intercept), *map(float, model.coefficients)]


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))


def personal_data(docs: DataFrame, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: counts of base spans, their digest, and all spans as ``kind:start:end``, comma-joined."""
    found = cut(found_spans(docs, id_col, text_col), "spans")
    weights = fitted(found, how)
    if weights is None:
        accepted = F.filter("open", lambda s: F.lit(False))
    else:
        least = math.log(how.least / (1 - how.least))

        def good(s: Column) -> Column:
            score = F.lit(weights[0])
            for weight, value in zip(weights[1:], _inputs(s["kind"], s["bits"])):
                if weight:
                    score = score + weight * value
            return score >= least

        accepted = F.filter("open", good)
    rows = found.withColumn("_added", accepted)

    def added(kind: str) -> Column:
        return F.transform(F.filter("_added", lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))

    base = F.concat(*[_listed(k, F.col(k)) for k in KINDS])
    every = F.concat(*[_listed(k, F.sort_array(F.concat(F.col(k), added(k)))) for k in KINDS])
    return rows.select(
        F.col("id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.size("_added").cast("long").alias("n_added"),
    )
