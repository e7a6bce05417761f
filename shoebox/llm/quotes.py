"""Quotation linking: quoted passages are joined to the messages they come from, and conversations put in reply order.

A line's quote level is the number of ``>`` signs at its start, with blanks between them. Successive lines of one level are a
passage. Passages are normalised (lower case, words of letters and digits joined by one space) and hashed, as are a message's own
lines, its own paragraphs and its own text as a whole. A quoted passage, or a line of it, is linked to the latest earlier message of
its conversation that has the same hash among its own. A message replies to the source of its links of lowest level, most words and
latest turn, in that order; a message without such a link replies to none and opens a thread.

A thread is named by its first turn. Sources are always earlier, so the order (thread, turn) puts every message after the
one that it replies to. The body is the message without quotes and without the lines that introduce them.

The latest earlier source is found per conversation and hash in two steps, within spans of ``SPAN`` turns and between the last rows
of the spans, so that a phrase which fills a long conversation is no single task. Threads are followed by pointer doubling.

Defined results: null texts have no lines; rows with null conversation or turn get no links and are their own
threads. Repeated rows (same conversation and turn) are each kept, share their links, and never quote one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.session import cut

SPAN = 256
_QUOTED = r"^\s*>"
# Lines such as "On Monday Ann wrote:" right above a quote.
_INTRODUCES = r"(?i)(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines_of(text: Column) -> Column:
    """Array of ``level, body, intro`` for each line; body is without its quote signs."""

    def line(raw: Column) -> Column:
        signs = F.regexp_extract(raw, r"^((?:\s*>)*)", 1)
        level = F.length(F.regexp_replace(signs, r"[^>]", ""))
        return F.struct(level.alias("level"), F.substring(raw, F.length(signs) + 1, F.length(raw)).alias("body"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), line)

    def marked(every: Column) -> Column:
        after = lambda i: F.coalesce(F.get(every, i + 1)["level"], F.lit(0))
        intro = lambda x, i: (x["level"] == 0) & (after(i) > 0) & x["body"].rlike(_INTRODUCES)
        return F.transform(every, lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), intro(x, i).alias("intro")))

    # Through a lambda, so that a line looks at the next one without making all lines again.
    return F.transform(F.array(lines), marked)[0]


def _runs(lines: Column) -> Column:
    """Successive lines of one level: array of ``level, body`` with the lines joined."""
    none = F.array().cast("array<struct<level:int,body:string>>")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(x["level"].alias("level"), x["body"].alias("body")))
        joined = F.array(F.struct(last["level"].alias("level"), F.concat_ws("\n", last["body"], x["body"]).alias("body")))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["level"] == x["level"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.concat(acc, one))

    return F.aggregate(lines, none, join)


def _hashed(passages: Column) -> Column:
    """Array of ``hash, words`` of normalised passages that have words."""
    known = F.filter(F.transform(passages, lambda p: normalised(p)), lambda p: p != "")
    return F.transform(F.array_distinct(known), lambda p: F.struct(F.sha2(p, 256).alias("hash"), F.size(F.split(p, " ")).alias("words")))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``body``, ``own`` hashes, and ``quotes`` (level, hash, words)."""
    rows = messages.withColumn("lines", lines_of(F.col("text")))
    rows = rows.withColumn("kept", F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["intro"]), lambda x: x["body"]))
    rows = rows.withColumn("body", F.trim(F.regexp_replace(F.array_join("kept", "\n"), r"\n\s*\n\s*\n+", "\n\n")))
    whole = F.array(F.col("body"))
    own = F.concat(whole, F.col("kept"), F.split("body", r"\n\s*\n"))
    quoted = F.filter(_runs(F.filter("lines", lambda x: ~x["intro"])), lambda r: r["level"] > 0)
    each = F.transform(
        quoted,
        lambda r: F.transform(
            _hashed(F.concat(F.array(r["body"]), F.split(r["body"], r"\n"), F.split(r["body"], r"\n\s*\n"))),
            lambda h: F.struct(r["level"].alias("level"), h["hash"].alias("hash"), h["words"].alias("words")),
        ),
    )
    # Most messages quote nothing, and need no passages.
    any_quote = F.exists("lines", lambda x: x["level"] > 0)
    quotes = F.when(any_quote, F.array_distinct(F.flatten(each))).otherwise(F.array().cast("array<struct<level:int,hash:string,words:int>>"))
    return rows.withColumn("own", _hashed(own)).withColumn("quotes", quotes).drop("lines", "kept")


def links(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, level, words, hash, source``: each quoted passage with the latest earlier turn that has it."""
    keyed = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = keyed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    asked = quotes.select("conv_id", "hash").distinct()
    sources = keyed.select("conv_id", "turn", F.explode("own").alias("o")).select("conv_id", "turn", F.col("o.hash").alias("hash")).distinct()
    sources = sources.join(asked, ["conv_id", "hash"], "left_semi")
    span = F.floor(F.col("turn") / SPAN)
    # Within a span: the last source before each quote; rows of one turn are no sources for each other.
    both = sources.select("conv_id", "hash", "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("words"), F.col("turn").alias("at"))
    both = both.unionByName(quotes.withColumn("at", F.lit(None).cast(dict(sources.dtypes)["turn"]))).withColumn("span", span)
    order = Window.partitionBy("conv_id", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("near", F.max("at").over(order))
    ends = sources.groupBy("conv_id", "hash", span.alias("span")).agg(F.max("turn").alias("last"))
    before = Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = both.select("conv_id", "hash", "span").distinct().join(ends, ["conv_id", "hash", "span"], "left").withColumn("far", F.max("last").over(before))
    found = both.filter(F.col("level").isNotNull()).join(spans.select("conv_id", "hash", "span", "far"), ["conv_id", "hash", "span"])
    found = found.withColumn("source", F.coalesce("near", "far")).filter(F.col("source").isNotNull())
    return found.select("conv_id", "turn", "level", "words", "hash", "source")


def threads(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, thread`` for rows ``conv_id, turn, reply_to``, by pointer doubling."""
    at = cut(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(False).alias("done")), "threads")
    while not at.filter(~F.col("done")).isEmpty():
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("done").alias("top"))
        step = at.join(up, ["conv_id", "thread"], "left")
        at = cut(
            step.select(
                "conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("done") | F.col("above").isNull() | F.col("top")).alias("done")
            ),
            "threads",
        )
    return at.select("conv_id", "turn", "thread")


def reply_order(messages: DataFrame) -> DataFrame:
    """``conv_id, thread, turn, role, reply_to, n_quotes, n_linked, body``; order by the first three."""
    rows = parsed(messages.select("conv_id", "turn", "role", "text"))
    found = cut(links(rows), "quote-links")
    best = F.max(F.struct((-F.col("level")).alias("level"), "words", "source"))
    replies = cut(found.groupBy("conv_id", "turn").agg(best.alias("b"), F.countDistinct("level", "hash").alias("n_linked")).select("conv_id", "turn", F.col("b.source").alias("reply_to"), "n_linked"), "replies")
    whole = rows.join(replies, ["conv_id", "turn"], "left").join(threads(replies), ["conv_id", "turn"], "left")
    return whole.select(
        "conv_id",
        F.coalesce("thread", "turn").alias("thread"),
        "turn",
        "role",
        "reply_to",
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "body",
    )
