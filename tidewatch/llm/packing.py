"""Sequence packing in document order by dynamic programming with a monotone queue."""

import gc
import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.blocks import handfuls

#: Costs in tokens of padding: a cut behind a sentence, one inside a sentence, and any sequence.
SENTENCE_COST, INSIDE_COST, SEQUENCE_COST = 2, 12, 1
#: No two places where a cut may fall are further apart than this many tokens.
GRID = 64
#: Tokens gathered before the dynamic program runs; its last sequence is carried over.
STREAM = 1 << 19
#: Bytes of a unit, tokens of a unit, and slots (a power of two) of the table of known units that a worker keeps.
UNIT_BYTES, UNIT_TOKENS, SLOTS = 24, 10, 1 << 20

#: Kinds of bytes: space, letter, digit, other signs, and bytes of units that the tokenizer itself must split.
SPACE, LETTER, DIGIT, SIGN, HARD = range(5)
KIND = np.full(256, SIGN, np.uint8)
KIND[128:] = KIND[0] = KIND[28:32] = HARD
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space characters that the tokenizer and ``str.split`` treat otherwise than the six above.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0]")
LANES = UNIT_BYTES // 8
#: The bytes of a lane that a unit with so many bytes left covers.
COVERED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def units_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of texts that begin at ``at``, which are whole words, and the bytes in lower case.

    A unit is a run of ASCII letters, a digit, a run of other signs, or a whole word that holds a
    byte outside these, an apostrophe before a letter, or the head of a special token.
    """
    n = len(data)
    kind = KIND[data]
    inside = kind != SPACE
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    word = inside.copy()
    word[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(word)
    hard = kind == HARD
    hard[:-1] |= (data[:-1] == 39) & (kind[1:] == LETTER) | (data[:-1] == 60) & (data[1:] == 124)
    whole = np.add.reduceat(hard, starts, dtype=np.int64) > 0 if len(starts) else np.empty(0, bool)
    begins = inside.copy()
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | edge[1:n]
    low = LOWER[data]
    if whole.any():
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | edge[1:n]
        ends = np.flatnonzero(stop) + 1
        cover = np.zeros(n + 1, np.int8)
        cover[starts[whole]] += 1
        np.subtract.at(cover, ends[whole], 1)
        cover = np.cumsum(cover[:-1], dtype=np.int8) > 0
        begins &= ~cover
        begins[starts[whole]] = True
        low[cover] = data[cover]
    stop = inside
    stop[:-1] = inside[:-1] & (begins[1:] | ~inside[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(stop) + 1
    own = np.zeros(n + 1, bool)
    own[starts[whole]] = True
    return first, last, own[first], low


class WordTokens:
    """Ids of whole texts from ids of their white-space-bounded words.

    The tokenizer's own pattern never lets a token cross white space, nor the bounds of a unit (see
    :func:`units_of`), so a text's ids are its units' ids in a row.  Units are found and looked up by
    whole columns: the table of known units has one slot a hash, which holds the unit's bytes and
    ids; a unit found there with all its bytes equal takes those ids, and each other distinct unit
    of the batch is tokenized and takes the slot.  Units of Latin letters go through a byte-pair
    encoder with the same merges, in which a zero byte marks a unit's end and joins the last byte
    before any other merge; words in other scripts go through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tool = Tokenizer.from_file(path)
        self.lanes = np.zeros((SLOTS, LANES), np.uint64)
        self.tokens = np.zeros((SLOTS, UNIT_TOKENS), "<u4" if self.tool.get_vocab_size() > 1 << 16 else "<u2")
        self.counts = np.zeros(SLOTS, np.int64)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        vocab = parts["model"]["vocab"]
        to_byte = byte_symbols()
        as_bytes = lambda piece: bytes(to_byte[c] for c in piece.removesuffix("</w>")) + b"\0" * piece.endswith("</w>")
        merges = [x if isinstance(x, list) else x.split(" ") for x in parts["model"]["merges"]]
        self.ids = np.zeros(512 + len(merges), "<u4")
        self.closes = np.arange(512 + len(merges)) < 256  # the tokens that end a word
        ranks: dict[bytes, int] = {}
        symbol = {v: k for k, v in to_byte.items()}
        for byte in range(256):  # ends first, then single bytes (never merged into), then the merges in their order
            ranks[bytes([byte, 0])], ranks[bytes([byte])] = byte, 256 + byte
            self.ids[byte], self.ids[256 + byte] = vocab[symbol[byte] + "</w>"], vocab[symbol[byte]]
        for n, (x, y) in enumerate(merges):
            ranks[as_bytes(x + y)] = 512 + n
            self.ids[512 + n], self.closes[512 + n] = vocab[x + y], y.endswith("</w>")
        self.core = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            ends[i] = piece.endswith("</w>") and piece[:-4].rstrip("\"')")[-1:] in (".", "!", "?")
        self.sentence_end = ends

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, word: str) -> list[str] | None:
        """The pieces that the tokenizer's pattern makes of a word of Latin letters and signs; None for other words."""
        if not (word.isascii() or max(word) < "\u0250") or "\0" in word or "<|" in word or ODD_SPACE.search(word):
            return None
        word = word.lower()
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and not word[-1].isalpha():
            return [word[:-1], word[-1]]
        return self.split.findall(word)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids in a row, and how many each has."""
        ids = np.array(self.core.encode_ordinary("\0 ".join(pieces) + "\0" if pieces else ""), np.int64)
        return self.ids[ids], np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0)

    def unit_ids(self, units: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units in a row, how many each has, and where each begins; ``whole`` marks words that are to be split."""
        plain, words = np.flatnonzero(~whole), np.flatnonzero(whole)
        texts = [units[k].decode() for k in words.tolist()]
        parts = list(map(self.parts, texts))
        odd = np.array([x is None for x in parts], bool)
        split = [x for x in parts if x is not None]
        flat, each = self.encode_pieces([*(b"\0".join([units[k] for k in plain.tolist()]).decode().split("\0") if len(plain) else ()), *(y for x in split for y in x)])
        counts = each[: len(plain)]
        if split:
            counts = np.concatenate([counts, np.add.reduceat(each[len(plain) :], np.cumsum([0, *map(len, split)])[:-1])])
        if odd.any():
            raw = self.raw([t for t, o in zip(texts, odd.tolist(), strict=True) if o])
            flat, counts = np.concatenate([flat, np.frombuffer(b"".join(raw), "<u4")]), np.concatenate([counts, [len(x) // 4 for x in raw]])
        order = np.concatenate([plain, words[~odd], words[odd]])
        n, begin = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        n[order], begin[order] = counts, np.cumsum(counts) - counts
        return flat, n, begin

    def __call__(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, each text's followed by ``end_id``, and the number of ids of each text with that one."""
        column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        raw = raw[int(offsets[0]) : int(offsets[-1])].to_pybytes() if raw is not None and len(offsets) else b""
        at = offsets - offsets[0]
        data, docs = np.frombuffer(raw, np.uint8), len(column)
        starts, ends, hard, low = units_of(data, at)
        size = ends - starts
        # the units' bytes in lanes of eight, zeros behind their ends
        padded = np.concatenate([low, np.zeros(UNIT_BYTES, np.uint8)])
        eight = np.ndarray((len(data) + UNIT_BYTES - 7,), "<u8", padded, strides=(1,))
        lanes = np.empty((len(starts), LANES), np.uint64)
        for lane in range(LANES):
            lanes[:, lane] = eight[np.minimum(starts + 8 * lane, len(data))] & COVERED[np.clip(size - 8 * lane, 0, 8)]
        h = size.astype(np.uint64)
        for lane in range(LANES):
            h = (h ^ lanes[:, lane]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        short = size <= UNIT_BYTES
        nul = np.flatnonzero(data == 0)  # zeros stand behind units in the table: a unit that holds one has no place there
        if len(nul):
            short[np.searchsorted(starts, nul, side="right") - 1] = False
        known = (self.lanes[slot] == lanes).all(axis=1) & short
        tokens, count = self.tokens[slot], self.counts[slot]
        late: list[tuple[int, np.ndarray]] = []  # rows of units that have no place in the table, and their ids
        missing = np.flatnonzero(~known)
        if len(missing):
            lower = low.tobytes()
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(lower[a:b], len(number)) for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)])
            units = list(number)
            odd = np.zeros(len(units), bool)
            odd[which[hard[missing]]] = True
            flat, counts, begin = self.unit_ids(units, odd)
            fits = counts <= UNIT_TOKENS
            inside = (np.arange(UNIT_TOKENS) < counts[:, None]) & fits[:, None]
            table = np.zeros((len(units), UNIT_TOKENS), self.tokens.dtype)
            table[inside] = flat[(begin[:, None] + np.arange(UNIT_TOKENS))[inside]]
            tokens[missing], count[missing] = table[which], counts[which]
            fit = missing[fits[which] & short[missing]]
            # of several units with one slot the last stays
            self.lanes[slot[fit]], self.tokens[slot[fit]], self.counts[slot[fit]] = lanes[fit], tokens[fit], count[fit]
            late = [(row, flat[begin[k] : begin[k] + counts[k]]) for row, k in zip(missing[~fits[which]].tolist(), which[~fits[which]].tolist(), strict=True)]
        first = np.searchsorted(starts, at)  # each text's first unit
        doc = np.repeat(np.arange(docs), np.diff(first))
        before = np.cumsum(count) - count + doc
        out = np.full(int(count.sum()) + docs, end_id, "<u4")
        put = np.arange(UNIT_TOKENS) < count[:, None]
        if late:
            put[[row for row, _ in late]] = False
        where = np.ones(len(out), bool)
        total = np.concatenate([[0], np.cumsum(count)])
        sizes = np.diff(total[first]) + 1
        where[np.cumsum(sizes) - 1] = False
        for row, ids in late:
            where[before[row] : before[row] + count[row]] = False
            out[before[row] : before[row] + count[row]] = ids
        out[where] = tokens[put]
        return out, sizes


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(2)
def tokens_of(path: str) -> WordTokens:
    return WordTokens(path)


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (numbers of tokens before them, the first 0) where a cut may fall, and what it costs there."""
    cost = np.full(len(ids) + 1, -1, np.int16)
    at = np.flatnonzero(sentence_end[np.minimum(ids, len(sentence_end) - 1)]) + 1
    cost[at] = SENTENCE_COST
    cost[doc_ends] = 0
    cost[0] = cost[-1] = 0
    places = np.flatnonzero(cost >= 0)
    far = np.flatnonzero(np.diff(places) > GRID)
    if len(far):
        more = np.concatenate([np.arange(a + GRID, b, GRID) for a, b in zip(places[far], places[far + 1], strict=True)])
        cost[more] = INSIDE_COST
        places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Indices into ``places``, first and last included, of the cheapest cuts.

    A sequence of n tokens pads size - n, or nothing where n is a power of two.  best[j] is the
    least best[i] + padding + cost[j] over places i within ``size``; padding grows with place i, so
    the least best[i] + place[i] in reach stands at the head of a monotone queue, and the few exact
    powers of two are tried beside it.
    """
    n = len(places)
    exact: list[list[int] | None] = [None] * n
    power = 1
    while power <= size:
        i = np.searchsorted(places, places - power)
        hit = np.flatnonzero((places >= power) & (places[np.minimum(i, n - 1)] == places - power))
        for j, k in zip(hit.tolist(), i[hit].tolist(), strict=True):
            if exact[j] is None:
                exact[j] = []
            exact[j].append(k)
        power *= 2
    at, price = places.tolist(), (cost + SEQUENCE_COST).tolist()
    best, back = [0] * n, [0] * n
    keys = [0] * n  # best[i] + place[i]
    queue: deque[int] = deque([0])
    for j in range(1, n):
        p = at[j]
        while at[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        value = keys[i] + size - p
        if exact[j]:
            for k in exact[j]:
                if best[k] <= value:
                    value, i = best[k], k
        value += price[j]
        best[j], back[j] = value, i
        key = keys[j] = value + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


class Packer:
    """Packs a stream of documents; what is known so far is cut once STREAM tokens are held, but for the last sequence."""

    def __init__(self, sentence_end: np.ndarray, size: int):
        self.sentence_end, self.size = sentence_end, size
        self.ids = np.empty(0, "<u4")  # tokens that are not out yet
        self.rest, self.done = np.empty(0, np.int64), np.empty(0, np.int64)  # each held document's tokens still to come, and out
        self.sequence = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.rest = np.concatenate([self.rest, sizes])
        self.done = np.concatenate([self.done, np.zeros(len(sizes), np.int64)])

    def cut(self, last: bool) -> tuple[np.ndarray, ...]:
        """``document, start, length, crc32, doc_tokens, sequence, offset`` of each piece; a document is its place among those held."""
        ends = np.cumsum(self.rest)
        places, cost = cut_places(self.ids, ends, self.sentence_end)
        cuts = places[best_cuts(places, cost, self.size)]
        if not last and len(cuts) > 2:
            cuts = cuts[:-1]  # the end of what is known so far forced the last sequence
        stop = int(cuts[-1])
        begins = np.unique(np.concatenate([cuts[:-1], ends[ends < stop]]))
        length = np.diff(np.append(begins, stop))
        doc, seq = np.searchsorted(ends, begins, side="right"), np.searchsorted(cuts, begins, side="right") - 1
        start = begins - (ends - self.rest)[doc] + self.done[doc]
        raw = memoryview(self.ids.view(np.uint8))
        crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), (begins + length).tolist(), strict=True)], np.int64)
        out = doc, start, length, crc, (self.rest + self.done)[doc], seq + self.sequence, begins - cuts[seq]
        self.sequence += len(cuts) - 1
        gone = int(np.searchsorted(ends, stop, side="right"))  # documents that are out whole
        inside = stop - (int(ends[gone - 1]) if gone else 0)
        self.ids, self.rest, self.done = self.ids[stop:], self.rest[gone:].copy(), self.done[gone:].copy()
        if len(self.rest):
            self.rest[0] -= inside
            self.done[0] += inside
        return out


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each input partition is packed in its own order, so nothing is shuffled and only a partition's
    last sequence can fall short; ``sequence_id`` holds the partition in its upper bits.  Null and
    empty texts are documents of the end id alone; long texts span sequences; repeated rows and
    null keys are documents like others; other columns are ignored; an empty table gives no piece.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens_of(path)
        packer, keys = Packer(tool.sentence_end, size), None
        upper = TaskContext.get().partitionId() << 33

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal keys
            doc, *cols = packer.cut(last)
            cols[4] += upper
            out = pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *[pa.array(c.astype(np.int64)) for c in cols]], names=names)
            keys = keys.slice(len(keys) - len(packer.rest))
            return out

        gc.disable()  # nothing here makes cycles, and the collector would walk the known words again and again
        try:
            for whole in batches:
                for b in handfuls(whole):
                    packer.add(*tool(b.column(1), end_id))
                    keys = pa.concat_arrays([keys, b.column(0)]) if keys is not None else b.column(0)
                    if len(packer.ids) >= STREAM:
                        yield flush(False)
            if len(packer.ids):
                yield flush(True)
        finally:
            gc.enable()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))

