import itertools

import numpy as np
from pyspark.sql import functions as F

from shoebox.llm import urlrules


def test_hosts_and_paths(spark):
    cases = {
        "http://M.Example.ORG/es/1?x#y": ("m.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "//example.org/es/": ("", "", None, "allow"),
        "x://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "x://a.com/fr/?://b.org/": ("a.com", "/fr/", "com/fr/", "allow"),
        "x://A.ORG": ("a.org", "", None, "allow"),
        "x://a.org#/es/": ("a.org", "", None, "allow"),
        "http://É.Org/": ("É.org", "/", "org/", "allow"),
        "http://a.com\n/de/": ("a.com\n", "/de/", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("rule", F.lit("z"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, labels).collect()}
    assert found == dict(enumerate(cases.values()))


def plain_rules(baskets, support, confidence):
    """All least token sets that meet both limits, by trying every set."""
    good, limit = {}, support * len(baskets)
    items = {t for tokens, _ in baskets for t in tokens}
    for size in range(1, 6):
        for some in itertools.combinations(sorted(items), size):
            have = [bad for tokens, bad in baskets if set(some) <= set(tokens)]
            if sum(have) >= limit and have and sum(have) / len(have) >= confidence:
                good[some] = sum(have) / len(have)
    return {s for s in good if not any(tuple(x for x in s if x != t) in good for t in s)}


def test_mined_rules_and_matches_against_all_sets(spark):
    rng = np.random.default_rng(6)
    baskets = []
    for _ in range(150):
        tokens = sorted({f"t{k}" for k in rng.integers(0, 6, 4)})
        bad = {"t1", "t3"} <= set(tokens) or rng.random() < 0.1
        baskets.append((tokens, bool(bad)))
    table = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    spec = urlrules.Mining(support=0.05, confidence=0.8)
    want = plain_rules(baskets, 10 / len(baskets), 0.8)
    rules = urlrules.mine(table, spec)
    assert {tuple(r["tokens"]) for r in rules.collect()} == want and ("t1", "t3") in want
    caught = {tuple(r["tokens"]) for r in urlrules.matches(table, rules).collect()}
    assert caught == {tuple(t) for t, _ in baskets if any(set(w) <= set(t) for w in want)}


def test_verdict_of_mined_rules(spark):
    urls = [f"https://{'win' if k % 2 else 'news'}.site{k % 7}.net/p/{k}" for k in range(60)] + ["https://win.org/x", "https://win.other.net/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)] + [(None, 0, 1), (3, None, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: (r["verdict"], r["rule"], r["mined"]) for r in urlrules.judge(pages, labels).collect()}
    assert found[1] == ("block", None, True) and found[2] == ("allow", None, False)
    assert found[60] == ("allow", "org/", True) and found[61] == ("block", None, True) and found[62] == ("allow", None, False)
    assert urlrules.judge(pages.limit(0), labels).count() == 0


def test_least_count_does_not_grow_with_the_table(spark):
    # Twelve bad urls of one host and of one pair of tokens among 20 000 good ones.
    rows = [(["h:net", f"p:{k % 400}", f"p:x{k % 7}"], False) for k in range(20_000)] + [(["h:net", "h:spam", f"p:{k}"], True) for k in range(12)]
    rows += [(["h:net", "p:a", "p:b"], True)] * 12 + [(["h:net", "p:a"], False)] * 50 + [(["h:net", "p:b"], False)] * 50 + [(["h:net", "h:few"], True)] * 9
    table = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    found = {tuple(r["tokens"]): r["confidence"] for r in urlrules.mine(table, urlrules.Mining()).collect()}
    assert found == {("h:spam",): 1.0, ("p:a", "p:b"): 1.0}


def test_long_urls_repeated_make_no_sets_of_all_their_tokens(spark):
    # 2 ** 40 sets stand for the same urls; no token of them is a rule.
    long = [f"p:{k:02}" for k in range(40)]
    table = spark.createDataFrame([(long, k % 2 == 0) for k in range(60)] + [(long[:20] + ["h:bad"], True)] * 10, "tokens array<string>, bad boolean")
    assert {tuple(r["tokens"]) for r in urlrules.mine(table, urlrules.Mining()).collect()} == {("h:bad",)}
