import re

import numpy as np

from shoebox.llm import licences
from tests.llm.helpers import AWKWARD, documents, prose, words


def bigrams(text):
    w = words(text)
    return set(zip(w, w[1:]))


def plain(text, least=licences.LEAST):
    text = text or ""
    spans = set()
    place = 0
    for line in text.split("\n"):
        spans.add((place, place + len(line)))
        place += len(line) + 1
    for match in re.finditer(r"[^\n]*[^ \t\r\n][^\n]*(?:\n[^\n]*[^ \t\r\n][^\n]*)*", text):
        spans.add(match.span())
    spans.add((0, len(text)))
    # The end of a line may or may not have its break; the words are the same.
    spans = {(s, e if e == len(text) or text[e - 1 : e] == "\n" else e + 1) for s, e in spans if e > s}
    best, count = {}, 0
    for s, e in spans:
        own, hit = bigrams(text[s:e]), False
        for name, group in licences.TEMPLATES.items():
            for template in group:
                other = bigrams(template)
                value = 2 * len(own & other) / (len(own) + len(other)) if own else 0
                if value >= least:
                    best[name], hit = max(value, best.get(name, 0)), True
        count += hit
    if not best:
        best = every_window(text, {n: [t for t in group if len(bigrams(t)) < 400] for n, group in licences.TEMPLATES.items()}, least)
        count = min(len(best), 1)
    top = min(best, key=lambda n: (-best[n], n)) if best else None
    return ",".join(sorted(best)), top, max(best.values(), default=0.0), count


def test_equals_plain_version(spark):
    rng = np.random.default_rng(9)
    texts = list(AWKWARD)
    notices = [t for group in licences.TEMPLATES.values() for t in group]
    for k, notice in enumerate(notices):
        w = " ".join(notice.split())
        texts += [w, w.upper(), f"{prose(rng, 20)}\n{w}\n{prose(rng, 9)}", f"{prose(rng, 20)}\n\n{notice}\n \n{prose(rng, 9)}", f"x {w} y", w + "\n" + w, "\n" + w + "\n"]
        some = w.split()
        for drop in (0.08, 0.2, 0.4):
            texts.append(" ".join(x for x in some if rng.random() > drop))
    rows = [*enumerate(texts), (3, texts[-1]), (None, notices[0])]
    found = licences.scan(documents(spark, [(i, t, "en") for i, t in rows])).collect()
    got = sorted((tuple(r) for r in found), key=repr)
    for a, b in zip(got, sorted(((i, *plain(t)) for i, t in rows), key=repr), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12 and a[4] == b[4], (a, b)


def test_licences_across_paragraphs_and_within_lines(spark):
    rng = np.random.default_rng(2)
    mit = licences.TEMPLATES["MIT"][3]
    mit = mit.replace(": The above", ":\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    gpl = licences.TEMPLATES["GPL-3.0"][1].replace(" This program is dist", "\n\nThis program is dist")
    texts = [f"{prose(rng, 300)}\n\n{t}\n\n{prose(rng, 300)}" for t in (mit, gpl)]
    texts += ["\n".join(f" * {line.strip()}" if line.strip() else " *" for line in texts[0].split("\n"))]
    texts += [f"{prose(rng, 40)} Licensed under the Apache License, Version 2.0. {prose(rng, 40)}", f"{texts[0]}\n\n{texts[1]}"]
    texts += [f"{prose(rng, 300)}\n\n{licences.TEMPLATES['BSD-3-Clause'][0].replace(' 3. ', chr(10) * 2 + '3. ')}\n\n{prose(rng, 300)}", prose(rng, 400)]
    found = {r["doc_id"]: r for r in licences.scan(documents(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    want = ["MIT", "GPL-3.0", "MIT", "Apache-2.0", None, "BSD-3-Clause", None]
    for i, name in enumerate(want):
        if i != 4:
            assert found[i]["best"] == name and (name is None or found[i]["dice"] > 0.95 and name in found[i]["licences"].split(",")), found[i]
    assert {"MIT", "GPL-3.0"} <= set(found[4]["licences"].split(",")) and found[4]["n_spans"] >= 2


def test_altered_notice_within_a_line(spark):
    rng = np.random.default_rng(5)
    mit = " ".join(licences.TEMPLATES["MIT"][3].split())
    named = mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "ACME CORPORATION")
    filled = " ".join(w + " inc" if rng.random() < 0.03 else w for w in mit.split())
    texts = [f"{prose(rng, 300)} {x} {prose(rng, 300)}" for x in (named, filled, mit)] + [prose(rng, 700)]
    found = {r["doc_id"]: r for r in licences.scan(documents(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, x in enumerate((named, filled, mit)):
        whole = 2 * len(bigrams(x) & bigrams(mit)) / (len(bigrams(x)) + len(bigrams(mit)))
        assert found[i]["licences"] == found[i]["best"] == "MIT" and found[i]["dice"] >= whole - 1e-12 and found[i]["n_spans"] == 1, found[i]
    assert found[0]["dice"] > 0.95 and found[2]["dice"] == 1 and found[3]["licences"] == ""


def every_window(text, templates, least):
    """Best coefficient per name of all windows of words that begin at a shared pair."""
    w = words(text)
    best = {}
    for name, group in templates.items():
        for template in map(bigrams, group):
            reach = 2 * int(len(template) * (2 - least) / least + 1e-9) + 1
            for i in range(len(w) - 1):
                if (w[i], w[i + 1]) not in template:
                    continue
                own = set()
                for pair in zip(w[i : i + reach], w[i + 1 : i + reach]):
                    own.add(pair)
                    value = 2 * len(own & template) / (len(own) + len(template))
                    if value >= least:
                        best[name] = max(value, best.get(name, 0))
    return best


def test_windows_equal_all_windows(spark):
    rng = np.random.default_rng(4)
    templates = {"long": [" ".join(f"a{i}" for i in range(24)), "b1 b2 b3 b4 b1 b2 b5 b6"], "short": ["c1 c2 c3 c4 c5"], "one": ["d1 d2"]}
    texts = []
    for _ in range(150):
        parts = [prose(rng, 30)]
        for _ in range(rng.integers(1, 5)):
            name = list(templates)[rng.integers(3)]
            some = templates[name][rng.integers(len(templates[name]))].split()
            worn = [x if rng.random() > 0.06 else "zz" for x in some if rng.random() > 0.06]
            parts += [" ".join(worn), prose(rng, rng.integers(0, 9))]
        texts.append(" ".join([*parts, prose(rng, 30)]))
    found = licences.scan(documents(spark, [(i, t, "en") for i, t in enumerate(texts)]), templates).collect()
    several = 0
    for row in found:
        want = every_window(texts[row["doc_id"]], templates, licences.LEAST)
        assert row["licences"] == ",".join(sorted(want)), (row, want)
        assert abs(row["dice"] - max(want.values(), default=0)) < 1e-12, (row, want)
        several += row["n_spans"] > 1
    assert several > 10


def test_empty_table(spark):
    assert licences.scan(documents(spark, [])).count() == 0
