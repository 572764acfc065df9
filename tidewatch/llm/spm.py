"""SentencePiece (merge-type) encoding through a prefix table, and decoding.

For a text without spaces inside, the encoding of each prefix ends in one certain piece.  An
automaton reports the pieces that end at each place; of those, the prefix's last piece is the one
whose own start's last piece it can follow, which a pair test decides.  From the end of the table
the ids are recovered backwards.
"""

import gc
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words that a worker keeps, twice: beyond that a new generation starts and the one before last goes.
CACHE_WORDS = 300_000


class Pieces:
    def __init__(self, path: str):
        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        n = tool.get_piece_size()
        plain = [i for i in range(n) if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i) or tool.is_unused(i))]
        self.text = {i: tool.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.text.items()}
        #: How early a piece is merged: its place by score; runs of spaces share one score and come last.
        score = {i: tool.get_score(i) for i in plain}
        self.rank = {i: r for r, i in enumerate(sorted((i for i in plain if self.text[i].strip(SPACE) or len(self.text[i]) == 1), key=lambda i: -score[i]))}
        self.byte = [tool.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte)}
        self.end = tool.eos_id()
        self.runs = {len(p): i for p, i in self.id.items() if set(p) == {SPACE}}
        # characters first, then pieces in the order of merging, each from its own last merge; those that merging never makes stay out
        self.left: dict[int, list[int]] = {}
        self.right: dict[int, list[int]] = {}
        #: For each piece, the pieces before it that have been tested: whether it can follow them.
        self.tested: list[dict[int, bool]] = [{} for _ in range(n)]
        self.size = [len(self.text.get(i, "")) for i in range(n)]
        self.surface_of = [self.text.get(i) for i in range(n)]
        self.alphabet = frozenset(p for p in self.id if len(p) == 1)
        #: Whether no piece holds both letters and other signs, so that words may be cut between them.
        self.separable = not any(p.isalpha() is False and any(map(str.isalpha, p)) for p in (x.lstrip(SPACE) for x in self.id))
        words = ahocorasick.Automaton()
        for i in sorted(self.rank, key=lambda i: (len(self.text[i]) > 1, self.rank[i])):
            p = self.text[i]
            if len(p) == 1:
                self.left[i] = self.right[i] = [i]
            elif (cut := self.last_merge(p)) is None:
                continue
            else:
                a, b = cut
                # the pieces that have stood at the piece's left and right border, in time
                self.left[i], self.right[i] = [*self.left[a], i], [*self.right[b], i]
            words.add_word(p, i)
        words.make_automaton()
        self.words = words

    def last_merge(self, p: str) -> tuple[int, int] | None:
        parts = [self.id.get(c) for c in p]
        if None in parts:
            return None
        while len(parts) > 2:
            best = min((self.rank.get(self.id.get(self.text[a] + self.text[b]), 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 30:
                return None
            k = best[1]
            parts[k : k + 2] = [self.id[self.text[parts[k]] + self.text[parts[k + 1]]]]
        return (parts[0], parts[1]) if parts[0] in self.left and parts[1] in self.left else None

    def follows(self, a: int, b: int) -> bool:
        """Whether merging a's and b's text leaves just these two.

        While both are built from their characters, pieces x and y stand at the border at a time;
        they would merge if that came before the next merge of either side (of equal merges the
        leftmost comes first, which at the left side is its own).
        """
        xs, ys, i, j, late, ok = self.right[a], self.left[b], 0, 0, 1 << 30, True
        while True:
            across = self.rank.get(self.id.get(self.text[xs[i]] + self.text[ys[j]]), late)
            x = self.rank[xs[i + 1]] if i + 1 < len(xs) else late
            y = self.rank[ys[j + 1]] if j + 1 < len(ys) else late
            if across < x and across <= y and across < late:
                ok = False
                break
            if x == y == late:
                break
            if x <= y:
                i += 1
            else:
                j += 1
        self.tested[b][a] = ok
        return ok

    def known_word(self, word: str) -> list[int]:
        """Ids of a word all of whose characters are pieces."""
        n = len(word)
        last = [-1] * (n + 1)
        last[0] = -2
        size, tested = self.size, self.tested
        for stop, i in self.words.iter(word):  # at each place the longest first
            if last[stop + 1] < 0:
                before = last[stop + 1 - size[i]]
                if before >= 0:
                    ok = tested[i].get(before)
                    if ok or (ok is None and self.follows(before, i)):
                        last[stop + 1] = i
                elif before == -2:
                    last[stop + 1] = i
        out = []
        while n:
            i = last[n]
            out.append(i)
            n -= size[i]
        return out[::-1]

    def word(self, word: str) -> list[int]:
        """Ids of a word; a character without a piece stands between the others as its bytes."""
        if self.alphabet.issuperset(word):
            return self.known_word(word)
        out, run = [], []
        for c in word:
            if c in self.alphabet:
                run.append(c)
                continue
            if run:
                out += self.known_word("".join(run))
                run = []
            out += [self.byte[b] for b in c.encode()]
        return out + (self.known_word("".join(run)) if run else [])

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of spaces: all their merges have one score, so the leftmost comes first."""
        longest = max(self.runs)
        whole = max(0, n - 64) // longest  # what has grown to the longest piece merges no more
        parts = [1] * (n - whole * longest)
        while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.runs), None)) is not None:
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.runs[longest]] * whole + [self.runs[k] for k in parts]

    def segment(self, s: str) -> list[int]:
        """Ids of some spaces and the word behind them."""
        word = s.lstrip(SPACE)
        n = len(s) - len(word)
        if not n:
            return self.word(word)
        if not word:
            return self.spaces(n)
        ids = self.word(SPACE + word)
        if n == 1:
            return ids
        lone = ids[0] == self.id[SPACE]
        return self.spaces(n - 1 + lone) + ids[lone:]

    def surface(self, ids: list[int]) -> str:
        """The text of ids, spaces still marked: byte pieces join to characters, broken ones to U+FFFD each."""
        found = list(map(self.surface_of.__getitem__, ids))
        if None not in found:
            return "".join(found)
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(decode_bytes(bytes(raw)))
                raw.clear()
            if i in self.text:
                out.append(self.text[i])
        return "".join(out)


def decode_bytes(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Coder:
    """Encodes and decodes whole texts; each distinct word is worked out once."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def ids(self, text: str) -> list[int]:
        return [i for s in self.split(text) for i in self.pieces.segment(s)] + [self.pieces.end]

    def decode(self, ids: list[int]) -> str:
        return self.finish(self.pieces.surface(ids))

    @staticmethod
    def finish(marked: str) -> str:
        return marked.removeprefix(SPACE).replace(SPACE, " ")

    def split(self, text: str) -> list[str]:
        """The text with its leading space, cut before every space that follows another character, and before a sign behind a word."""
        if not text:
            return []
        parts = (" " + text).replace(SPACE, " ").split(" ")
        out, spaces = [], 0
        for p in parts[1:]:
            spaces += 1
            if p:
                if not p[-1].isalpha() and p[:-1].isalpha() and self.pieces.separable:
                    out.append(SPACE * spaces + p[:-1])
                    out.append(p[-1])
                else:
                    out.append(SPACE * spaces + p)
                spaces = 0
        if spaces:
            out.append(SPACE * spaces)
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded text."""
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        parts = self.split(text)
        for s in set(parts).difference(young):
            if (x := old.get(s)) is None:
                ids = self.pieces.segment(s)
                surface = self.pieces.surface(ids)
                x = len(ids), " ".join(map(str, ids)), s if surface == s else surface
            young[s] = x
        got = list(map(young.__getitem__, parts))
        names = " ".join([*[x[1] for x in got], str(self.pieces.end)])
        decoded = self.finish("".join([x[2] for x in got]))
        return sum([x[0] for x in got]) + 1, sha256(names.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of every row: encoded with an end id, then decoded.

    Null and empty texts have the end id alone; texts are read whole, at any length; repeated rows
    and null keys stay as they are; other columns are ignored; an empty table gives none.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(path)
        gc.disable()  # nothing here makes cycles, and the collector would walk the known words again and again
        try:
            for b in batches:
                got = [tool.digest(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` of every row: the ids themselves, with the end id; cases as in :func:`token_digests`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(path)
        for b in batches:
            ids = pa.array([np.array(tool.ids(t or ""), np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["key", "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids array<int>")
