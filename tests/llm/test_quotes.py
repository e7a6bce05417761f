from pyspark.sql import functions as F

from shoebox.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("body", F.lit(1)).withColumn("thread", F.lit("x"))
    return {(r["conv_id"], r["turn"]): r for r in quotes.reply_order(table).collect()}


def test_nested_quotes_and_order(spark):
    rows = [
        (1, 0, "a", "Where do we meet?\n\nAt the old mill, or the bridge?"),
        (1, 1, "b", "Something else entirely."),
        (1, 2, "c", "Ann wrote:\n> Where do we  MEET\n> \n> At the old mill, or the bridge?\nThe mill."),
        (1, 3, "d", "> > Where do we meet?\n> The mill.\nFine."),
        (1, 4, "e", "> something else entirely\nWhat?\n> At the old mill, or the bridge?\nNo."),
        (1, 5, "f", "> never said\nHm."),
        (2, 1, "g", "> Where do we meet?\nOther conversation."),
        (1, 6, None, None),
        (None, 3, "h", "> Fine."),
        (3, None, "h", "> Fine."),
    ]
    found = run(spark, rows)
    assert len(found) == len(rows)
    assert found[1, 2]["reply_to"] == 0 and found[1, 2]["body"] == "The mill."
    assert found[1, 3]["reply_to"] == 2 and found[1, 3]["thread"] == 0 and found[1, 3]["n_linked"] == 2
    assert found[1, 4]["reply_to"] == 0 and found[1, 4]["body"] == "What?\nNo."
    assert found[1, 5]["reply_to"] is None and found[1, 5]["thread"] == 5 and found[1, 5]["n_quotes"] == 1
    assert found[2, 1]["reply_to"] is None
    assert found[1, 6]["body"] == "" and found[None, 3]["reply_to"] is None and found[3, None]["thread"] is None
    order = sorted((r["thread"], r["turn"]) for k, r in found.items() if k[0] == 1)
    for (conv, turn), r in found.items():
        if r["reply_to"] is not None:
            assert order.index((r["thread"], r["reply_to"])) < order.index((r["thread"], turn))


def plain(rows):
    """Latest earlier turn of the same conversation with the quoted phrase."""
    said, out = {}, {}
    for conv, turn, quoted, own in sorted(rows):
        out[conv, turn] = said.get((conv, quoted))
        said[conv, own] = turn
    return out


def test_hot_conversation_against_plain_version(spark):
    rows = [(7, t, f"phrase {t * 7 % 11 if t % 3 else 0}", f"phrase {t * 5 % 11 if t % 4 else 0}") for t in range(1500)]
    rows += [(8, t, "phrase 0", "phrase 0") for t in range(0, 90_000, 300)]
    found = run(spark, [(c, t, "user", f"> {q}\n{o}.") for c, t, q, o in rows])
    want = plain(rows)
    assert {k: r["reply_to"] for k, r in found.items()} == want
    root = {}
    for conv, turn, *_ in sorted(rows):
        root[conv, turn] = root[conv, want[conv, turn]] if want[conv, turn] is not None else turn
    assert {k: r["thread"] for k, r in found.items()} == root


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "a", "One thing.\nAnother."), (1, 1, "b", "> One thing.\nYes."), (1, 1, "b", "> One thing.\nYes.")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = quotes.reply_order(table).collect()
    assert len(found) == 3 and [r["reply_to"] for r in found if r["turn"] == 1] == [0, 0]
    assert quotes.reply_order(table.limit(0)).count() == 0
