"""Personal data: exact base patterns, and a character BiLSTM with CRF transitions trained in numpy."""

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import handfuls

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match that starts inside a run of digits would start at the run's head as well, so the look-behind loses nothing
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind in linear time; failing ones are dropped without a retry."""
    out: list[Span] = []
    if "@" in text:
        at, end = text.find("@"), 0
        while at >= 0:
            start = at
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                end = m.end()
            at = text.find("@", at + 1)
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(small_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


DIGIT = re.compile("[0-9]")
#: Every span of any kind holds one of these characters; and what stands between white space.
TRIGGER, RUN = re.compile("[0-9@]"), re.compile(r"\S+")

# ---------------------------------------------------------------- the model

TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
NT = len(TAGS)
#: Windows of this many characters, each starting half a window after the one before.
WINDOW, STRIDE = 64, 32
#: Characters of a part of a long region, and how far it reaches into the next part.
PART, OVERLAP = 2048, 512
SYMBOLS = " @.-+()_%:,;/\n"


@lru_cache(1)
def char_table() -> np.ndarray:
    """Character class of each code point below 128 (others: 0): letters by case-folded letter, digits as one class."""
    t = np.zeros(128, np.int64)
    for i, c in enumerate(SYMBOLS):
        t[ord(c)] = 1 + i
    for d in "0123456789":
        t[ord(d)] = 1 + len(SYMBOLS)
    for i in range(26):
        t[97 + i] = t[65 + i] = 2 + len(SYMBOLS) + i
    return t


N_CLASSES = 28 + len(SYMBOLS)


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, char_table()[np.minimum(code, 127)], 0)


def allowed() -> np.ndarray:
    """CRF transitions that BIO tagging permits: I-k only behind B-k or I-k, or first (row NT), where a window cuts a span."""
    ok = np.ones((NT + 1, NT), bool)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            ok[:, j] = False
            ok[[TAGS.index("B" + t[1:]), j, NT], j] = True
    return ok


def sample_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` labelled windows: prose of invented words with labelled spans, and look-alikes labelled O."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    syllables = ["an", "er", "the", "tion", "ou", "le", "ch", "de", "en", "re", "st", "ing", "al", "ra", "os", "und"]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    digits = lambda k: "".join(str(rng.integers(10)) for _ in range(k))

    def entity(kind: str) -> str:
        if kind == "email":
            local = f"{word()}{pick(['', '.', '_', '+'])}{pick([word(), digits(2)])}" if rng.random() < 0.7 else pick([".", "-", "_"]).join(word() for _ in range(rng.integers(2, 9)))
            e = f"{local}@{word()}{pick(['', '', digits(1)])}.{pick(['com', 'org', 'net', 'example.com', 'io', word() + '.de'])}"
            at = rng.integers(len(e.split("@")[0]))
            return e[:at] + pick(["\u00e9", "\u00fc", "\u0436"]) + e[at + 1 :] if rng.random() < 0.3 else e
        if kind == "ip":
            return ".".join(str(rng.integers(256)) for _ in range(4))
        if kind == "card":
            d, s = digits(16), pick(["", " ", "-"])
            return s.join(d[i : i + 4] for i in range(0, 16, 4))
        head = f"+{rng.integers(1, 99)}{pick([' ', '-', ' ('])}" if rng.random() < 0.8 else pick(["(", "0"])
        return f"{head}{digits(3)}{pick([' ', '-', ') '])}{digits(3)}{pick([' ', '-', ''])}{digits(4)}"

    def decoy() -> str:
        return pick([lambda: digits(rng.integers(1, 7)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)},{digits(3)}", lambda: f"{digits(32)}"])()

    xs, ys = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text = "\n" * 12 if rng.random() < 0.3 else ""  # beyond its start and end a text is read as line ends
        tags, mark = [0] * len(text), rng.integers(5)
        while len(text) < WINDOW + 24:
            if mark < 4 and 12 <= len(text) and rng.random() < 0.3:
                kind = KINDS[mark]
                e = entity(kind)
                b = TAGS.index(f"B-{kind}")
                tags += [b] + [b + 1] * (len(e) - 1)
                mark = 9
            else:
                e = decoy() if rng.random() < 0.06 else word()
                tags += [0] * len(e)
            gap = pick([" ", " ", " ", ", ", ". ", "\n"])
            text, tags = text + e + gap, tags + [0] * len(gap)
        cut, stop = rng.integers(24), WINDOW if rng.random() < 0.8 else rng.integers(WINDOW // 3, WINDOW)
        xs[row, :stop], ys[row, :stop] = classes(text)[cut : cut + stop], tags[cut : cut + stop]
        xs[row, stop:] = classes("\n")[0]
    return xs, ys


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, forward and backward LSTM, linear emissions and a linear-chain CRF."""

    def __init__(self, hidden: int = 16, embed: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"E": w(N_CLASSES, embed), "V": w(2 * hidden, NT), "c": np.zeros(NT, np.float32), "T": np.zeros((NT + 1, NT), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(embed + hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
        self.forbidden = np.where(allowed(), 0, -1e4).astype(np.float32)

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x is (batch, time, embed); the backward direction reads it from the end."""
        n, steps, h = len(x), range(x.shape[1]), self.h
        s, c, out, tape = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((n, x.shape[1], h), np.float32), []
        for t in steps if d == "f" else reversed(steps):
            z = np.concatenate([x[:, t], s], axis=1)
            a = z @ self.p[f"W{d}"] + self.p[f"b{d}"]
            g = sigmoid(a[:, : 3 * h])
            i, f, o, u = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(a[:, 3 * h :])
            before, c = c, f * c + i * u
            th = np.tanh(c)
            s = o * th
            out[:, t] = s
            tape.append((t, z, i, f, o, u, before, th))
        return out, tape

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.p["E"][x]
        (a, ta), (b, tb) = self.lstm(e, "f"), self.lstm(e, "b")
        hid = np.concatenate([a, b], axis=2)
        return hid @ self.p["V"] + self.p["c"], (e, hid, ta, tb)

    def crf(self) -> tuple[np.ndarray, np.ndarray]:
        t = self.p["T"] + self.forbidden
        return t[NT], t[:NT]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a batch and its gradient."""
        em, (e, hid, ta, tb) = self.emissions(x)
        first, trans = self.crf()
        n, steps = x.shape
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = first + em[:, 0]
        for t in range(1, steps):
            alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + trans, 1) + em[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(trans[None] + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)
        path = first[y[:, 0]] + em[rows, 0, y[:, 0]]
        for t in range(1, steps):
            path = path + trans[y[:, t - 1], y[:, t]] + em[rows, t, y[:, t]]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_em = np.exp(alpha + beta - z[:, None, None])
        grad["T"][NT] = d_em[:, 0].sum(axis=0)
        np.add.at(grad["T"][NT], y[:, 0], -1)
        for t in range(1, steps):
            pair = np.exp(alpha[:, t - 1][:, :, None] + trans + (em[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            grad["T"][:NT] += pair.sum(axis=0)
            np.add.at(grad["T"], (y[:, t - 1], y[:, t]), -1)
        d_em[rows[:, None], np.arange(steps)[None, :], y] -= 1
        grad["V"], grad["c"] = np.einsum("nth,ntk->hk", hid, d_em), d_em.sum(axis=(0, 1))
        d_hid = d_em @ self.p["V"].T
        d_e = np.zeros_like(e)
        h = self.h
        for d, tape, part in (("f", ta, d_hid[:, :, :h]), ("b", tb, d_hid[:, :, h:])):
            ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, zz, i, f, o, u, before, th in reversed(tape):
                ds = ds + part[:, t]
                dc = dc + ds * o * (1 - th * th)
                da = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), ds * th * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                grad[f"W{d}"] += zz.T @ da
                grad[f"b{d}"] += da.sum(axis=0)
                dz = da @ self.p[f"W{d}"].T
                d_e[:, t] += dz[:, :-h]
                ds, dc = dz[:, -h:], dc * f
        np.add.at(grad["E"], x, d_e)
        return float((z - path).mean()), {k: v / n for k, v in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 3) -> "Tagger":
        """Adam with a falling rate."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        total, n = epochs * -(-len(x) // batch), 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // batch)):
                _, g = self.step(x[rows], y[rows])
                n += 1
                now = rate * (1 - n / (total + 1))
                for k in self.p:
                    d = np.clip(g[k], -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of each window, and each position's margin of the tag's emission over O."""
        em, _ = self.emissions(x)
        tags = self.best_path(em)
        return tags, np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] - em[:, :, 0]

    def best_path(self, em: np.ndarray) -> np.ndarray:
        """Viterbi tags of rows of emissions."""
        first, trans = self.crf()
        n, steps, _ = em.shape
        score, back = first + em[:, 0], np.zeros((n, steps, NT), np.int8)
        for t in range(1, steps):
            s = score[:, :, None] + trans
            back[:, t] = s.argmax(axis=1)
            score = s.max(axis=1) + em[:, t]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        return tags


@lru_cache(1)
def trained(windows: int = 2400, epochs: int = 10) -> Tagger:
    """The tagger fitted on ``windows`` labelled windows, a fixed bound; the same in every process."""
    return Tagger().fit(*sample_windows(windows, 11), epochs)


def plausible(kind: str, piece: str) -> bool:
    """What each kind must hold at least, so that the tagger's spans stay precise; each needs a digit or an at sign.

    Looser than the base patterns: letters of any script in an address, a telephone number that
    begins with a bracket or a zero, a card whose digits are parted by dots.
    """
    n = sum("0" <= c <= "9" for c in piece)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}", piece))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", piece)) and all(map(small_octet, piece.split(".")))
    return (16 <= n <= 19 and luhn(re.sub(r"\D", "", piece))) if kind == "card" else (piece[0] in "+(0" and 8 <= n <= 15)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of a text in which spans can stand: what is not white space around each trigger, and STRIDE characters about it.

    No plausible span lacks a trigger, and none but numbers in groups, which hold triggers themselves, crosses white space.
    """
    out: list[list[int]] = []
    for m in RUN.finditer(text):
        if TRIGGER.search(m[0]):
            a, b = max(0, m.start() - STRIDE) // STRIDE * STRIDE, min(len(text), m.end() + STRIDE)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [(a, b) for a, b in out]


def pieces(a: int, b: int) -> list[tuple[int, int]]:
    """A region in parts that are decoded side by side, each OVERLAP characters into the next."""
    return [(s, min(b, s + PART + OVERLAP)) for s in range(a, max(a + 1, b - OVERLAP), PART)]


def reconcile(spans: dict[Span, float]) -> list[Span]:
    """Of all windows' spans of one text, the non-overlapping set with the largest sum of scores."""
    order = sorted(spans, key=lambda s: (s[2], s[1]))
    best: list[tuple[float, int, Span | None]] = [(0.0, 0, None)]
    ends = [0]
    for s in order:
        at = bisect.bisect_right(ends, s[1], 1) - 1
        with_s = best[at][0] + spans[s]
        best.append((with_s, at, s) if with_s > best[-1][0] else (best[-1][0], len(best) - 1, None))
        ends.append(s[2])
    out, i = [], len(best) - 1
    while i:
        if best[i][2]:
            out.append(best[i][2])
        i = best[i][1]
    return out[::-1]


def merged_emissions(texts: list[str], where: list[tuple[int, int, int]], tagger: Tagger) -> list[np.ndarray]:
    """Emissions of parts ``(text, start, end)``: those of overlapping windows are averaged, each weighing most in its middle."""
    slots = [(n, s) for n, (_, a, b) in enumerate(where) for s in range(a - STRIDE, b, STRIDE)]
    out = [np.zeros((b - a, NT), np.float32) for _, a, b in where]
    weight = [np.zeros((b - a, 1), np.float32) for _, a, b in where]
    tent = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)[:, None]
    for at in range(0, len(slots), 1024):
        part = slots[at : at + 1024]
        x = np.full((len(part), WINDOW), classes("\n")[0])
        for r, (n, s) in enumerate(part):
            c = classes(texts[where[n][0]][max(0, s) : s + WINDOW])
            x[r, max(0, -s) : max(0, -s) + len(c)] = c
        em, _ = tagger.emissions(x)
        for r, (n, s) in enumerate(part):
            _, a, b = where[n]
            low, high = max(a, s), min(b, s + WINDOW)
            if low < high:
                out[n][low - a : high - a] += em[r, low - s : high - s] * tent[low - s : high - s]
                weight[n][low - a : high - a] += tent[low - s : high - s]
    return [e / w for e, w in zip(out, weight, strict=True)]


def decoded_parts(em: list[np.ndarray], tagger: Tagger) -> list[np.ndarray]:
    """Viterbi tags of parts of any lengths; those of like length are decoded together."""
    tags: list[np.ndarray] = [np.empty(0, np.int64)] * len(em)
    order = sorted(range(len(em)), key=lambda n: len(em[n]))
    for at in range(0, len(order), 256):
        group = order[at : at + 256]
        steps = len(em[group[-1]])
        padded = np.zeros((len(group), steps, NT), np.float32)
        padded[:, :, 0] = 1e4  # behind its end a part is outside any span
        for r, n in enumerate(group):
            padded[r, : len(em[n])] = em[n]
        got = tagger.best_path(padded)
        for r, n in enumerate(group):
            tags[n] = got[r, : len(em[n])]
    return tags


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans of each text: windows' emissions are merged, regions decoded, and spans reconciled over the whole text.

    A span of the tagger may be as long as a region; beyond OVERLAP characters one that begins in the
    last part of a long region's part may be cut there.
    """
    where = [(i, *p) for i, t in enumerate(texts) for r in regions(t) for p in pieces(*r)]
    found: list[dict[Span, float]] = [{} for _ in texts]
    for at in range(0, len(where), 512):
        some = where[at : at + 512]
        emissions = merged_emissions(texts, some, tagger)
        for (i, a, _), em, row in zip(some, emissions, decoded_parts(emissions, tagger), strict=True):
            text = texts[i]
            for b in np.flatnonzero(row % 2 == 1).tolist():
                e = b + 1
                while e < len(row) and row[e] == row[b] + 1:
                    e += 1
                kind = KINDS[(row[b] - 1) // 2]
                score = float((em[np.arange(b, e), row[b:e]] - em[b:e, 0]).mean())
                if score > 0 and plausible(kind, text[a + b : a + e]):
                    key = (kind, a + b, a + e)
                    found[i][key] = max(found[i].get(key, 0.0), score)
    return [reconcile(f) if f else [] for f in found]


def new_spans(extra: list[Span], base: list[Span]) -> list[Span]:
    """Those of the tagger's spans that touch no base span, or are wider than all that they touch, of their own kind."""
    base = sorted(base, key=lambda s: s[1])
    starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    out = []
    for span in extra:
        at, fits = bisect.bisect_left(starts, span[2]) - 1, True
        while fits and at >= 0 and reach[at] > span[1]:  # no earlier base span ends behind this one's start
            x = base[at]
            fits = x[2] <= span[1] or (x[0] == span[0] and span[1] <= x[1] and x[2] <= span[2] and x != span)
            at -= 1
        if fits:
            out.append(span)
    return out


def all_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and those that the tagger adds: beside them, or around one that caught a part only."""
    texts = [t or "" for t in texts]
    hot = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
    base = {i: base_spans(texts[i]) for i in hot}
    extra = dict(zip(hot, model_spans([texts[i] for i in hot], tagger), strict=True))
    rank = {k: n for n, k in enumerate(KINDS)}
    out = []
    for i in range(len(texts)):
        b = sorted(base.get(i, ()), key=lambda s: (rank[s[0]], s[1]))
        out.append((b, new_spans(extra.get(i, []), b)))
    return out


SPAN_TYPE = "struct<kind:string,start:bigint,end:bigint>"


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, added)`` of every row; both are arrays of ``struct<kind, start, end>`` in code points.

    Null text is empty and has no spans; texts are read whole, at any length; repeated rows and null
    keys stay as they are; other columns are ignored; an empty table gives none.  No shuffle.
    """
    tagger = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        put = lambda ss: [{"kind": k, "start": a, "end": b} for k, a, b in ss]
        for whole in batches:
            for b in handfuls(whole):
                got = all_spans(b.column(1).to_pylist(), tagger)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([put(x) for x, _ in got], kind), pa.array([put(y) for _, y in got], kind)], names=["key", "base", "added"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, base array<{SPAN_TYPE}>, added array<{SPAN_TYPE}>")


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with each personal span of ``text`` replaced by ``[KIND]`` and ``size`` brought up to date.

    Overlapping spans of different kinds are replaced as one, by the first kind's mark.  Null texts
    stay null, empty ones empty; texts of any length are read whole; repeated rows, null keys and
    other columns stay as they are; an empty table stays empty.
    """
    tagger = trained()
    schema = docs.schema

    def clean(t: str | None, spans: list[Span]) -> str | None:
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return t if not spans else "".join(out) + t[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            i = whole.schema.get_field_index(text)
            for b in handfuls(whole, i):
                texts = b.column(i).to_pylist()
                new = pa.array([clean(t, x + y) for t, (x, y) in zip(texts, all_spans(texts, tagger), strict=True)], b.schema.field(i).type)
                b = b.set_column(i, b.schema.field(i), new)
                if (j := b.schema.get_field_index(size)) >= 0:
                    b = b.set_column(j, b.schema.field(j), pa.compute.utf8_length(new).cast(b.schema.field(j).type))
                yield b

    import pyarrow.compute  # noqa: F401

    return docs.mapInArrow(run, schema)
