"""Personal data: base spans against plain regular expressions, and what the tagger adds, wherever it stands."""

import random
import re

import numpy as np
import pytest

from tidewatch.llm import pii

ADDRESS = "jürgen.von-der-schmidt.abteilung_vertrieb.nord@post.beispiel-versand.example"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The contract's kinds by plain regular expressions: leftmost, not overlapping, failing matches dropped."""
    out = {("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)}
    out |= {("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))}
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.add(("card", m.start(), m.end()))
    return out | {("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15}


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_base_spans_equal_plain_expressions(tagger):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x.co", ".", "-", "+", "+4", "1", "22", "255", "256", "4111111111111111", "4111 1111 1111 1111", " ", "  ", "(", ")", "é", "٣", "😀", "\n", "10.0.0.1", "%", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    for text, (base, added) in zip(texts, pii.all_spans(texts, tagger), strict=True):
        assert set(base) == plain(text)
        assert not set(added) & set(base)


def test_a_long_address_is_found_at_every_offset(tagger):
    fill = "the quick words of prose and some more here "
    texts = [(fill * 4)[:n] + " " + ADDRESS + " " + fill for n in range(128)]
    assert len(ADDRESS) == 76
    found = [("email", n + 1, n + 77) in added for n, (_, added) in enumerate(pii.all_spans(texts, tagger))]
    assert all(found)  # the base pattern catches what follows the letter outside ASCII only


def test_the_tagger_adds_what_base_patterns_lack(tagger):
    texts = ["Please call (555) 123-4567 soon, thanks a lot.", "Schreiben Sie an rené@example.org bitte noch."]
    got = [[(k, t[a:b]) for k, a, b in added] for t, (_, added) in zip(texts, pii.all_spans(texts, tagger), strict=True)]
    assert got == [[("phone", "(555) 123-4567")], [("email", "rené@example.org")]]


def test_the_tagger_finds_most_base_spans_by_itself(tagger):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "er", "the", "ou", "le", "st", "ing"]) for _ in range(rng.randint(1, 3)))
    texts, want = [], []
    for _ in range(300):
        e = rng.choice([f"{word()}.{word()}@{word()}.com", ".".join(str(rng.randrange(256)) for _ in range(4)), f"+{rng.randrange(1, 99)} {rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"])
        head = " ".join(word() for _ in range(rng.randint(0, 30)))
        texts.append(f"{head} {e} " + " ".join(word() for _ in range(8)))
        want.append((len(head) + 1, len(head) + 1 + len(e)))
    found = [w in {(a, b) for _, a, b in s} for w, s in zip(want, pii.model_spans(texts, tagger), strict=True)]
    assert np.mean(found) > 0.8


def test_plausible_spans_hold_a_trigger():
    """Regions hold every trigger and all that is joined to it, so no plausible span is lost to them."""
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice(["word", " ", "@", "7", "é" * 40, ".", "\n"]) for _ in range(rng.randint(0, 40)))
        held = np.zeros(len(text) + 1, bool)
        for a, b in pii.regions(text):
            held[a:b] = True
        for m in re.finditer(r"\S+", text):
            assert not re.search("[0-9@]", m[0]) or held[m.start() : m.end()].all()
    assert not any(pii.plausible(k, p) for k in pii.KINDS for p in ("word", "+(abc", "a.b.c", "("))


def test_new_spans():
    base = [("card", 0, 30), ("ip", 5, 9), ("email", 12, 20), ("phone", 40, 50)]
    extra = [("email", 10, 20), ("email", 30, 40), ("phone", 40, 50), ("phone", 38, 52), ("ip", 45, 60), ("card", 60, 61)]
    assert pii.new_spans(extra, base) == [("email", 30, 40), ("phone", 38, 52), ("card", 60, 61)]
    assert pii.new_spans([("email", 11, 21)], base[2:]) == [("email", 11, 21)]


def test_long_texts_and_parts(tagger):
    big = "call +1 (555) 123-4567 or x1@y.zz, " * 20000
    ((base, _),) = pii.all_spans([big], tagger)
    assert len(base) == 40000
    digits = "7" * 9000 + " a@b.cd"
    ((base, _),) = pii.all_spans([digits], tagger)
    assert base == [("email", 9001, 9007)]
    assert pii.pieces(0, 6000) == [(0, 2560), (2048, 4608), (4096, 6000)] and pii.pieces(10, 10 + 2560) == [(10, 2570)]


def test_merged_emissions_do_not_depend_on_the_windows_start(tagger):
    text = "abc " * 30 + "mail me@here.org now " + "def " * 30
    ((a, b),) = pii.regions(text)
    one = pii.merged_emissions([text], [(0, a, b)], tagger)[0]
    assert one.shape == (b - a, pii.NT) and np.isfinite(one).all()


def test_redaction_masks_the_wider_span(spark):
    df = spark.createDataFrame([(1, "Schreiben Sie an rené@example.org bitte noch.", 45), (2, None, 0), (3, "", 0)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df).collect()}
    assert got[1] == ("Schreiben Sie an [EMAIL] bitte noch.", 36) and got[2][0] is None and got[3] == ("", 0)
