"""License scan against brute force over all windows, its anchor gate, and rows that share a key."""

import random

from tidewatch.llm import license

DOCS = "doc_id long, text string, template string, row long, step int"
FILL = ["alpha", "beta", "gamma", "delta", "license", "software", "the", "of", "and", "conditions"]


def grams(ws):
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]


def contained(text):
    """Of each template, the best share in any window of the operator's windows, and whether it reaches the threshold."""
    ws, out = license.plain_words(text or ""), {}
    for name, notice in license.TEMPLATES.items():
        want = set(grams(license.plain_words(notice)))
        step = 1
        while step < len(want):
            step *= 2
        got = grams(ws)
        best = max((len(want & set(got[a : a + 2 * step])) for a in range(0, max(1, len(got)), step)), default=0)
        if got and best >= 0.8 * len(want):
            out[name] = best / len(want)
    return out


def damaged(rng, notice, share):
    """A notice with some of its words changed, so that its containment lies about 0.6 to 1."""
    ws = notice.split()
    for _ in range(int(share * len(ws) / 5)):
        ws[rng.randrange(len(ws))] = rng.choice(FILL)
    return " ".join(ws)


def texts(n=250):
    rng = random.Random(8)
    out = [None, "", "one two three", "Licensed under CC BY-NC 4.0"]
    for _ in range(n):
        words = [rng.choice(FILL) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randint(0, len(words)), damaged(rng, rng.choice(list(license.TEMPLATES.values())), rng.choice([0, 0, 0.3, 0.6, 1.0])))
        out.append(" ".join(words))
    return out


def test_scan_equals_brute_force(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(ts)], DOCS).repartition(4)
    got = {}
    for r in license.scan_licenses(spark, df).collect():
        got.setdefault(r["key"], {})[r["template"]] = r["containment"]
    want = {i: c for i, t in enumerate(ts) if (c := contained(t))}
    assert got == want and sum(0.8 <= x < 1 for c in want.values() for x in c.values()) >= 10  # recall 1, at the threshold too


def test_anchor_gate_loses_nothing():
    words = set(license.anchors(license.TEMPLATES))
    rng = random.Random(3)
    for _ in range(3000):
        text = damaged(rng, rng.choice(list(license.TEMPLATES.values())), rng.choice([0, 0.3, 0.6, 1.0, 2.0]))
        assert not contained(text) or words & set(license.plain_words(text))


def test_rows_of_one_key_are_not_mixed(spark):
    half = license.TEMPLATES["bsd"].split()
    rows = [(k, " ".join(part), "x", 1, 2) for k in (None, 7) for part in (half[:13], half[8:])] + [(9, license.TEMPLATES["bsd"], "x", 1, 2)] * 2 + [(None, license.TEMPLATES["mit"], "x", 1, 2)]
    got = sorted((r["key"] or 0, r["template"], r["containment"]) for r in license.scan_licenses(spark, spark.createDataFrame(rows, DOCS).coalesce(1)).collect())
    assert got == [(0, "mit", 1.0), (9, "bsd", 1.0), (9, "bsd", 1.0)]
