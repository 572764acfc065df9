"""Phrase collocations against a plain count, with hot words, long texts, nulls and ties."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, n int"


def plain(rows, least=10, share=50, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            ws = [w for w in re.split(r"[ \t]", piece) if w]
            n[lang] += len(ws)
            for i in range(len(ws)):
                for m in (1, 2, 3):
                    if i + m <= len(ws):
                        f[lang, tuple(ws[i : i + m])] += 1
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, ws), a in cand.items():
        subs = [(s, a2) for (g, s), a2 in cand.items() if g == lang and len(s) == 3 and len(ws) == 2 and ws in (s[:2], s[1:])]
        if any(100 * b >= share * a for _, b in subs):
            continue
        score, k = min((1000000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, got in out.items() for i, (s, a, p, x, y) in enumerate(sorted(got)[:top]))


def texts(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "of", "The", "a", "b", "new", "york", "é", "x'y", "日本"] + [f"w{i}" for i in range(40)]
    weights = [40, 30, 10, 10, 8, 6, 6, 4, 3, 3] + [1] * 40
    out = []
    for _ in range(n):
        ws = rng.choices(words, weights, k=rng.randint(0, 60))
        out.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for w in ws), rng.choice(["en", "en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", None), (" \t.,", "de"), ("new york city " * 30, "en"), ("new york city " * 30, "en"), ("z " * 3000, "de")]


@pytest.mark.parametrize("bucket", [1 << 19, 40])
def test_collocations(spark, monkeypatch, bucket):
    monkeypatch.setattr(phrases, "BUCKET", bucket)  # small buckets make most words hot
    rows = texts(bucket)
    df = spark.createDataFrame([(i if i % 7 else None, t, g, "p", 1, 2) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(spark, df).collect())
    assert got == plain(rows) and len(got) > 20
    few = sorted(tuple(r) for r in phrases.collocations(spark, df, top=5, least=4).collect())
    assert few == plain(rows, least=4, top=5)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(spark, empty).count() == 0
    assert phrases.collocations(spark, spark.createDataFrame([(1, None, None, "", 1, 1)], SCHEMA)).count() == 0


def test_scores_past_64_bits(spark):
    text = "p q. " * 30000 + "p. q. " * 10
    row = phrases.collocations(spark, spark.createDataFrame([(1, text, "en", "", 1, 1)] * 40, SCHEMA)).first()
    a, part = 40 * 30000, 40 * 30010
    assert tuple(row) == ("en", 1, "p q", a, part, part, 2 * part, 1000000 * a * a // (part * part)) and 1000000 * a * a > 1 << 60


def test_quicksort_counts_with_every_lead():
    rng = np.random.default_rng(3)
    keys = rng.zipf(1.5, (4000, 3)).astype(np.int64) % 30
    keys[rng.random(4000) < 0.1, 1:] = phrases.END
    keys[rng.random(4000) < 0.1, 2] = phrases.END
    weight = rng.integers(1, 4, len(keys))
    want = Counter()
    for row, w in zip(keys.tolist(), weight.tolist(), strict=True):
        for k in (2, 3):
            if phrases.END not in row[:k]:
                want[tuple(row[:k])] += w
    for lead in (1, 2, 3):
        level, at, count = phrases.sort_counts(keys, weight, 10, lead)
        got = {tuple(keys[p, :k].tolist()): c for k, p, c in zip(level.tolist(), at.tolist(), count.tolist(), strict=True)}
        assert len(got) == len(level)
        for phrase, c in want.items():
            assert got.get(phrase) == c if c >= 10 or len(phrase) < lead else phrase not in got


def test_slices_end_with_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "TOGETHER", 50)
    rng = random.Random(5)
    for _ in range(200):
        raw = "".join(rng.choice(["ab ", "c", ". ", "x" * rng.randint(1, 120)]) for _ in range(rng.randint(0, 60))).encode()
        parts = list(phrases.slices(raw))
        assert b"".join(parts) == raw and all(p[-1:] == b"." for p in parts[:-1])
