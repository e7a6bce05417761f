"""Personal data: base spans against plain patterns, EM against enumeration, added spans on planted texts."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from shoebox.llm import pii
from tests.llm.helpers import AWKWARD, documents, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, pattern in PLAIN.items() for m in re.finditer(pattern, text or "") if passes(k, m[0])]


def card(rng, digits=16, first="4"):
    body = first + "".join(str(rng.integers(10)) for _ in range(digits - 1 - len(first)))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def run(spark, texts, how=pii.Fit()):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in pii.personal_data(documents(spark, rows).repartition(3), how).collect()}


def check_base(row, text):
    want = base(text)
    counts = [sum(k == kind for k, *_ in want) for kind in PLAIN]
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts, text[:200]
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), text[:200]
    spans = [tuple(s.split(":")) for s in row.spans.split(",") if s]
    spans = [(k, int(s), int(e)) for k, s, e in spans]
    assert set(want) <= set(spans) and len(spans) == len(want) + row.n_added
    assert spans == sorted(spans, key=lambda s: (list(PLAIN).index(s[0]), s[1]))
    return set(spans) - set(want)


CASES = [
    "a@b.c_d@e.f g@h..i j@k.l.m. x@y", "a@b@c.d %+-._@x-y.z-", "é😀 me@host.org 😀 1.2.3.4 😀", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.000.00.255 1.2.3.0256",
    "4111 1111 1111 1111 x 4111-1111-1111-1112 4111  1111 1 2", "+1 (386) 555-3733, +49 30 (0) 1234567- +12 +1 2 3 ++123456789+1.2.3.4.5.6.7.8.9",
    "+1234567890123456 +123 456 789 4111111111111111", "1" * 13 + " 0000000000000", "a.a.a@" + "b." * 3000 + "c", "7.7.7.7" * 40, "+" * 500 + "1 " * 400, "- - 12-34",
]


def test_base_spans_equal_plain_patterns(spark):
    rng = np.random.default_rng(5)
    symbols = list("ab1290.@+-() ,é😀\n%_") + ["11", "4111 1111 1111 1111", "me@x.org", "10.0.0.1", "+49 30 1234567", "255"]
    texts = CASES + AWKWARD + ["".join(rng.choice(symbols, rng.integers(1, 80))) for _ in range(300)]
    texts += [" ".join(f"u{i}@h.org 10.0.{i % 256}.1" for i in range(3000)), "1" * 50_000, "a" * 40_000 + "@" + "b" * 40_000, "x " * 20_000 + "me@x.org"]
    got = run(spark, texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        check_base(got[i], text or "")


def test_rows_repeat_and_tables_may_be_empty(spark):
    rows = documents(spark, [(None, "me@x.org", "en"), (None, "me@x.org", "en"), (1, None, None)])
    got = pii.personal_data(rows)
    assert got.columns[:6] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in got.collect()) == [(0, 1, "email:0:8"), (0, 1, "email:0:8"), (1, 0, "")]
    assert pii.personal_data(documents(spark, [])).count() == 0


def posterior(counts, chance, how):
    """One plain round of EM for one kind: maximise, then the chance of every pattern by the product rule."""
    width = len(next(iter(counts)))
    share = (sum(n * chance[v] for v, n in counts.items()) + 1) / (sum(counts.values()) + 2)

    def table(labeler, truth, vote):
        if not vote:
            return 1
        prior = {truth: how.right, -truth: how.wrong}
        mass = {x: prior[x] + sum(n * (chance[v] if truth > 0 else 1 - chance[v]) for v, n in counts.items() if v[labeler] == x) for x in prior}
        return mass[vote] / sum(mass.values())

    out = {}
    for v in counts:
        yes = share * math.prod(table(i, 1, v[i]) for i in range(width))
        no = (1 - share) * math.prod(table(i, -1, v[i]) for i in range(width))
        out[v] = yes / (yes + no)
    return out


def test_em_equals_plain_rounds_and_finds_the_reliable_labelers():
    rng = np.random.default_rng(2)
    right = [0.95, 0.9, 0.6, 0.85, 0.5, 0.7]
    counts, true = {}, {}
    for _ in range(4000):
        truth = 1 if rng.random() < 0.3 else -1
        v = tuple(0 if rng.random() < 0.2 else truth if rng.random() < p else -truth for p in right)
        counts[v] = counts.get(v, 0) + 1
        true[v] = true.get(v, 0) + (truth > 0)
    how = pii.Fit(rounds=7)
    chance = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v in counts}
    for _ in range(how.rounds):
        chance = posterior(counts, chance, how)
    got = pii.reliabilities({("ip", v): n for v, n in counts.items()}, how)
    assert all(abs(got["ip", v] - chance[v]) < 1e-9 for v in counts)
    # The best decisions, by the chances the votes were drawn with.
    best = {v: 0.3 * math.prod(p if x > 0 else 1 - p for x, p in zip(v, right) if x) > 0.7 * math.prod(1 - p if x > 0 else p for x, p in zip(v, right) if x) for v in counts}

    def errors(said):
        return sum(n - true[v] if said[v] else true[v] for v, n in counts.items())

    assert errors({v: got["ip", v] >= 0.5 for v in counts}) <= 1.1 * errors(best) + 5


def planted(rng):
    """A text around one loose form, with its span, or around something that only looks like one."""
    octets = ".".join(str(rng.integers(10, 220)) for _ in range(4))
    number = card(rng)
    loose = {
        "email": rng.choice([f"mail n{rng.integers(99)}x [at] host{rng.integers(9)} [dot] org", f"e-mail me.you(at)mail{rng.integers(9)}.com", f"contact jo{rng.integers(99)} at example dot net"]),
        "ip": "server " + octets.replace(".", "[.]"),
        "card": "visa " + rng.choice([".", " – ", "/"]).join(number[i : i + 4] for i in range(0, 16, 4)),
        "phone": rng.choice([f"call (0{rng.integers(100, 999)}) {rng.integers(1000, 9999)} {rng.integers(1000, 9999)}", f"tel 0049 30 {rng.integers(1000, 9999)} {rng.integers(1000, 9999)}", f"phone (212) 555-{rng.integers(1000, 9999)}"]),
    }
    decoy = [
        f"order {rng.integers(1000, 9999)}/{rng.integers(1000, 9999)}/{rng.integers(10000, 99999)}", f"version {rng.integers(1, 9)}[.]0[.]0[.]1", f"token x{'0' * 4} 0000 0000 0000",
        f"invoice {rng.integers(100, 999)}-{rng.integers(100, 999)}-{rng.integers(100, 999)}", "at 12:30:45:10", "look at this. It was at the door.",
    ]
    if rng.random() < 0.5:
        return prose(rng, 8) + " " + rng.choice(decoy) + " " + prose(rng, 5), None
    kind = rng.choice(list(loose))
    cue, _, span = loose[kind].partition(" ")
    head = prose(rng, 8) + f" {cue} "
    return head + span + " " + prose(rng, 5), (kind, len(head), len(head) + len(span))


def test_added_spans_on_planted_texts(spark):
    rng = np.random.default_rng(8)
    strict = [f"{prose(rng, 6)} mail a{i}.b@mail.example.com and 81.92.{i % 250}.7 card {card(rng)} call +1 (212) 555-{1000 + i} number {i} of 20{i % 90 + 10}" for i in range(60)]
    cases = [planted(rng) for _ in range(240)]
    texts = strict + [t for t, _ in cases]
    got = run(spark, texts)
    hit = missed = extra = 0
    for i, text in enumerate(texts):
        added = check_base(got[i], text)
        want = cases[i - len(strict)][1] if i >= len(strict) else None
        hit += want in added
        missed += want is not None and want not in added
        extra += len(added - {want})
    assert hit >= 0.9 * (hit + missed), (hit, missed, extra)
    assert extra <= 0.05 * (hit + extra), (hit, missed, extra)


@pytest.mark.parametrize("bits", range(0, 256, 5))
def test_votes_are_votes(bits):
    assert set(pii.votes(bits)) <= {-1, 0, 1}
    assert len(set(itertools.chain(pii.FEATURES))) == 8
