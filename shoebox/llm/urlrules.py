"""URL filters: rules for hosts and paths, then association rules mined from labelled urls.

A url's tokens are the labels of its host and the words of its path. Labelled urls become baskets of their tokens.
FP-growth finds the token sets that enough bad urls hold, at every size of the table the same number; how many of all
labelled urls hold such a set, and so its confidence, comes from a join through an inverted index. A rule needs both, and
only least rules are kept, as a longer one would block nothing more. Before mining, tokens that stand in the same labelled
urls become one, and tokens that are rules by themselves are taken out: neither changes the least rules, up to the choice
between tokens that are never apart. Rules are matched through an inverted index as well: each is listed under its rarest
token, so a url looks up its tokens and checks only the rules found there.

Fixed rules go first: a rule fits its host and the host's subdomains where the path starts with the rule's path; the
longest one decides. A url that no rule fits is blocked if a mined rule matches it, else allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, no tokens, and is allowed. Labels of
unknown pages are not used, repeated labels of a page make it bad if any does. Repeated rows give a row each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Fixed rules: host and path, verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}


@dataclass(frozen=True)
class Mining:
    """Least number of bad urls with a rule's tokens (and their share of labelled urls, if any is asked for), and least share of bad ones among those with its tokens."""

    support: float = 0.0
    urls: int = 10
    confidence: float = 0.8


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url.cast("string"), r"(?s)^.*?://(.*)$", 1))


def host_of(url: Column) -> Column:
    """What stands between ``://`` and the next slash, question mark or hash, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark or hash; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, _, below = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels (``h:``) and path words (``p:``)."""
    labels = F.transform(F.split(host, r"[.:@-]"), lambda t: F.concat(F.lit("h:"), t))
    parts = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda t: F.concat(F.lit("p:"), t))
    return F.array_sort(F.array_except(F.array_distinct(F.concat(labels, parts)), F.array(F.lit("h:"), F.lit("p:"))))


def _least(rules: DataFrame) -> DataFrame:
    """Rules that hold no other rule."""
    inner = rules.select(F.col("tokens").alias("inner"), F.array_min("tokens").alias("t"))
    outer = rules.select("tokens", F.explode("tokens").alias("t"))
    longer = outer.join(inner, "t").filter((F.size("inner") < F.size("tokens")) & (F.size(F.array_except("inner", "tokens")) == 0))
    return rules.join(longer.select("tokens").distinct(), "tokens", "left_anti")


def mine(baskets: DataFrame, spec: Mining) -> DataFrame:
    """``tokens, confidence, support`` of the rules found in rows ``tokens, bad``."""
    sets = baskets.filter(F.size("tokens") > 0).select(F.array_sort("tokens").alias("held"), F.col("bad").cast("long").alias("bad"))
    sets = sets.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    sets = cut(sets.withColumn("basket", F.monotonically_increasing_id()), "baskets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(1, spec.urls, math.ceil(spec.support * total))
    confidence = F.col("bad") / F.col("n")

    def rules_of(counted: DataFrame) -> DataFrame:
        good = counted.filter((F.col("bad") >= least) & (confidence >= spec.confidence))
        return good.select("tokens", confidence.alias("confidence"), (F.col("n") / F.lit(max(1, total))).alias("support"))

    placed = sets.select("basket", "n", "bad", F.explode("held").alias("token"))
    # Tokens of the same baskets have the same counts and hash sums.
    marks = [F.sum(F.xxhash64("basket", F.lit(k)).cast("decimal(38,0)")).alias(f"mark{k}") for k in (1, 2)]
    counts = placed.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), *marks).filter(F.col("bad") >= least)
    kept = cut(counts.groupBy("n", "bad", "mark1", "mark2").agg(F.min("token").alias("token")).select("token", "n", "bad"), "tokens")
    single = rules_of(kept.withColumn("tokens", F.array("token")))
    open_tokens = kept.filter(confidence < spec.confidence).select("token")
    placed = cut(placed.join(open_tokens, "token", "left_semi"), "placed")
    bad_baskets = placed.filter(F.col("bad") > 0).groupBy("basket", "bad").agg(F.collect_set("token").alias("items"))
    bad_baskets = cut(bad_baskets.filter(F.size("items") > 1).select("items", F.explode(F.sequence(F.lit(1), F.col("bad").cast("int")))).select("items"), "bad")
    urls = bad_baskets.count()
    if urls < least:
        return single
    # The half keeps the rounding of the product below the count that is asked for.
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / urls, minConfidence=1.0).fit(bad_baskets).freqItemsets
    found = cut(found.filter(F.size("items") > 1).select(F.array_sort("items").alias("tokens")), "frequent")
    # Each set is looked up under its token of fewest baskets.
    often = placed.groupBy("token").agg(F.count(F.lit(1)).alias("baskets"))
    listed = found.select("tokens", F.explode("tokens").alias("token")).join(often, "token")
    listed = listed.groupBy("tokens").agg(F.min(F.struct("baskets", "token")).alias("r")).select("tokens", "r.token")
    around = placed.join(listed, "token").join(sets.select("basket", "held"), "basket").filter(F.size(F.array_except("tokens", "held")) == 0)
    counted = around.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return _least(cut(single.unionByName(rules_of(counted)), "rules"))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens`` (distinct) of ``urls`` that hold all tokens of some rule, by an inverted index of the rules."""
    sets = urls.select("tokens").filter(F.size("tokens") > 0).distinct()
    placed = sets.select("tokens", F.explode("tokens").alias("token"))
    needed = rules.select(F.col("tokens").alias("needs"), F.explode("tokens").alias("token"))
    # The index lists a rule under its token that fewest distinct urls have.
    often = placed.join(needed.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    index = needed.join(often, "token").groupBy("needs").agg(F.min(F.struct("count", "token")).alias("r")).select("needs", "r.token")
    met = placed.join(index, "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    return met.select("tokens").distinct()


def judge(pages: DataFrame, labels: DataFrame, spec: Mining = Mining(), id_col: str = "page_id", url_col: str = "url", label_col: str = "doc_id") -> DataFrame:
    """``page_id, host, path, rule, verdict``, and whether a mined rule matched."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("page_id")).agg(F.max(bad).alias("bad"))
    rules = cut(mine(rows.join(marks, "page_id").select("tokens", "bad"), spec), "mined")
    caught = cut(matches(rows, rules), "caught").withColumn("mined", F.lit(True))
    rows = rows.join(caught, "tokens", "left").withColumn("rule", fixed_rule(F.col("host"), F.col("path")))
    listed = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))
    verdict = F.coalesce(listed[F.col("rule")], F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("mined", F.lit(False)).alias("mined"))
