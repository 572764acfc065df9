"""Phrase collocations: counts by multikey three-way quicksort of suffix pointers, routed by leading words.

1. Every task counts the words of its texts; the sums say how often each word leads a phrase.
2. Every place where a word stands is a suffix, read for as many words as a phrase may have.  Equal
   suffixes of some megabytes of text become one with a weight, and go to the bucket of their leading
   word.  A hot leading word (see :func:`hot_words`) would overfill its bucket: its suffixes are
   routed by the words up to the first one that is not hot.
3. A bucket sorts pointers to its suffixes word by word (:func:`sort_counts`): parts equal in a word are
   a phrase, their weight is its count, and parts too rare for a candidate are abandoned unsorted.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.blocks import handfuls
from tidewatch.llm.scratch import cut
from tidewatch.llm.spread import join_spread

#: Kinds of bytes: parts of words, blanks between words, and bounds of pieces; and A-Z in lower case.
WORD, BLANK, BOUND = range(3)
KIND = np.full(256, WORD, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[list(b".,;:!?\n\x0b\x0c\r")] = BOUND
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are taken together: of one language, and of all.
TOGETHER, HELD = 1 << 22, 1 << 24
#: Suffixes that a bucket holds, about.
BUCKET = 1 << 19
#: At most so many words are hot, so that 8 bytes a hot word are 8 MB at most.
HOT_WORDS = 1 << 20
#: Buckets are dealt into at most so many tasks.
TASKS = 1 << 14
END = -1


class Words:
    """The words of some texts: ``words`` distinct, ``ids`` of all in a row, and the piece that each stands in."""

    def __init__(self, raw: bytes):
        data = LOWER[np.frombuffer(raw, np.uint8)]
        kind = KIND[data]
        inside = kind == WORD
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(kind == BOUND), starts)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        told = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.words, self.ids = told.dictionary, told.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def suffixes(self, depth: int) -> np.ndarray:
        """The ``depth`` ids from each word on, END behind its piece."""
        out = np.full((len(self.ids), depth), END, np.int64)
        for d in range(min(depth, len(self.ids))):
            stays = self.piece[d:] == self.piece[: len(self.piece) - d]
            out[: len(stays), d] = np.where(stays, self.ids[d:], END)
        return out


def collapsed(rows: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, sorted, and how often each occurs."""
    depth, base = rows.shape[1], vocabulary + 1
    if base**depth < 1 << 63:
        code = rows[:, 0] + 1
        for d in range(1, depth):
            code = code * base + rows[:, d] + 1
        code, times = np.unique(code, return_counts=True)
        out = np.empty((len(code), depth), np.int64)
        for d in reversed(range(depth)):
            code, out[:, d] = np.divmod(code, base)
        return out - 1, times
    return np.unique(rows, axis=0, return_counts=True)


def slices(raw: bytes) -> Iterator[bytes]:
    """A long text in slices of some megabytes that end with a piece; only a longer piece makes a longer slice."""
    at = 0
    while len(raw) - at > TOGETHER:
        bounds = np.flatnonzero(KIND[np.frombuffer(raw, np.uint8, TOGETHER, at)] == BOUND)
        stop = at + TOGETHER
        while not len(bounds) and stop < len(raw):
            bounds = np.flatnonzero(KIND[np.frombuffer(raw, np.uint8, min(TOGETHER, len(raw) - stop), stop)] == BOUND)[:1]
            if len(bounds):
                bounds = bounds + (stop - at)
            stop += TOGETHER
        end = at + int(bounds[-1]) + 1 if len(bounds) else len(raw)
        yield raw[at:end]
        at = end
    if at < len(raw):
        yield raw[at:]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """The words of ``(lang, text)`` batches, some megabytes of one language at a time."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str) -> Iterator[tuple[str, Words]]:
        for part in slices(b"\n".join(held.pop(lang))):
            yield lang, Words(part)
        del sizes[lang]

    for whole in batches:
        for b in handfuls(whole):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                    if sizes[lang] >= TOGETHER:
                        yield from flush(lang)
            if sum(sizes.values()) >= HELD:
                for lang in list(held):
                    yield from flush(lang)
    for lang in list(held):
        yield from flush(lang)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def routes(rows: np.ndarray, hashes: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's bucket, and by how many leading words it is routed: up to the first that is not hot, or all."""
    spot = np.searchsorted(hot, hashes)
    is_hot = hot[np.minimum(spot, len(hot) - 1)] == hashes if len(hot) else np.zeros(len(hashes), bool)
    is_hot, hashes = np.append(is_hot, False), np.append(hashes, np.uint64(0))  # END stands at the end
    lead = np.ones(len(rows), np.int64)
    mix = hashes[rows[:, 0]]
    going = is_hot[rows[:, 0]]
    for d in range(1, rows.shape[1]):
        lead += going
        mix = np.where(going, (mix * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[rows[:, d]] + np.uint64(d)), mix)
        going = going & is_hot[rows[:, d]]
    return ((mix ^ (mix >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64), lead


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers from zero up, in one, four or eight bytes each."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {n: np.uint8, 4 * n: np.uint32, 8 * n: np.uint64}[len(raw)]).astype(np.int64) if n else np.empty(0, np.int64)


def sort_counts(keys: np.ndarray, weight: np.ndarray, least: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the suffixes ``keys``: number of words, a pointer to a suffix that begins with it, and its count.

    Multikey three-way quicksort of pointers, all parts of a generation at once: each part takes a
    pivot among its words at its depth and splits into less, equal and greater; the equal part goes
    one word deeper and is a phrase, with its weight as count.  A part that weighs less than
    ``least`` can hold no candidate and is abandoned, unless its suffixes were routed by more words
    (``lead``) than the part agrees in: then others like it may lie in other buckets.
    """
    n, depth = keys.shape
    pointer = np.arange(n)
    start, size, level = np.array([0]), np.array([n]), np.array([0])
    rng = np.random.default_rng(1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):
        total = int(size.sum())
        part = np.repeat(np.arange(len(start)), size)
        begin = np.cumsum(size) - size
        pointer = pointer[np.arange(total) + np.repeat(start - begin, size)]
        word = keys[pointer, np.repeat(level, size)]
        tries = word[begin + (rng.random((3, len(start))) * size).astype(np.int64)]
        pivot = np.sort(tries, axis=0)[1][part]
        side = (word > pivot).astype(np.int8) - (word < pivot)
        # a stable move of each part's less, equal and greater pointers side by side
        counts = np.stack([np.add.reduceat(side == c, begin, dtype=np.int64) for c in (-1, 0, 1)], axis=1)
        first = begin[:, None] + np.cumsum(counts, axis=1) - counts
        to = np.empty(total, np.int64)
        for c in (-1, 0, 1):
            mine = np.flatnonzero(side == c)
            within = np.arange(len(mine)) - np.repeat(np.cumsum(counts[:, c + 1]) - counts[:, c + 1], counts[:, c + 1])
            to[mine] = first[part[mine], c + 1] + within
        moved = np.empty(total, np.int64)
        moved[to] = pointer
        pointer = moved
        start, size = first.ravel(), counts.ravel()
        level = np.repeat(level, 3) + np.tile([0, 1, 0], len(begin))
        equal = np.tile([False, True, False], len(begin))
        some = size > 0
        start, size, level, equal = start[some], size[some], level[some], equal[some]
        heavy = np.add.reduceat(weight[pointer], start) if len(start) else np.empty(0, np.int64)
        known = np.where(equal, level, level + 1)  # words that the part's phrases have at least
        real = ~equal | (keys[pointer[start], np.maximum(level - 1, 0)] != END)  # what is equal at END is no longer phrase
        stays = real & ((heavy >= least) | (known < lead))
        told = stays & equal & (level > 1)
        out.append((level[told], pointer[start[told]], heavy[told]))
        stays &= level < depth
        start, size, level = start[stays], size[stays], level[stays]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def texts_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, phrase, f)`` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, got in gathered(batches):
            times = np.bincount(got.ids, minlength=len(got.words))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(times), pa.string()), got.words.cast(pa.large_string()).cast(pa.string()), pa.array(times)], names=["lang", "phrase", "f"])

    return texts_of(docs, text, lang).mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def hot_words(words: DataFrame, total: int) -> np.ndarray:
    """Sorted hashes of the words that lead more suffixes than two buckets should hold, HOT_WORDS of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_hash(g, w.encode()) for g, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.uint64()).cast(pa.int64(), safe=False)], names=["h"])

    often = words.where(F.col("f") > max(2 * BUCKET, total // HOT_WORDS)).select("lang", "phrase")
    return np.sort(np.array([r["h"] for r in often.mapInArrow(run, "h bigint").collect()], np.int64).view(np.uint64))


def phrase_counts(docs: DataFrame, hot: np.ndarray, buckets: int, depth: int, least: int, text: str, lang: str) -> DataFrame:
    """``(lang, phrase, f)`` of the phrases of 2 to ``depth`` words that occur ``least`` times or more."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, got in gathered(batches):
            rows, times = collapsed(got.suffixes(depth), len(got.words))
            hashes = np.array([word_hash(name, w) for w in got.words.to_pylist()], np.uint64)
            bucket, lead = routes(rows, hashes, hot, buckets)
            group = bucket * (depth + 1) + lead
            order = np.argsort(group, kind="stable")
            group, rows, times = group[order], rows[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
            stop = np.append(at[1:], len(group))
            flat = got.words.take(pa.array(rows.ravel(), mask=rows.ravel() == END))  # null behind a piece
            offsets = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
            data, length = memoryview(flat.buffers()[2] or b""), np.diff(offsets)
            length = np.where(rows.ravel() == END, 0, length)
            cols: list[list] = [[], [], []]
            for a, b in zip(at.tolist(), stop.tolist(), strict=True):
                cols[0].append(narrow(times[a:b]))
                cols[1].append(narrow(length[depth * a : depth * b]))
                cols[2].append(bytes(data[offsets[depth * a] : offsets[depth * b]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[at] // (depth + 1)), pa.array([name] * len(at), pa.string()), pa.array((group[at] % (depth + 1)).astype(np.int32)), pa.array((stop - at).astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]],
                names=["bucket", "lang", "lead", "n", "times", "lengths", "words"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            n = sum(h[0] for h in held)
            weight = np.concatenate([wide(h[1], h[0]) for h in held])
            length = np.concatenate([wide(h[2], depth * h[0]) for h in held])
            offsets = np.concatenate([[0], np.cumsum(length)])
            told = pa.Array.from_buffers(pa.large_binary(), depth * n, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(h[3] for h in held))]).dictionary_encode()
            keys = told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys[length == 0] = END
            level, at, times = sort_counts(keys.reshape(-1, depth), weight, least, now[2])
            keys = keys.reshape(-1, depth)
            used = np.unique(keys[at])
            text_of = dict(zip(used.tolist(), told.dictionary.take(pa.array(np.maximum(used, 0))).to_pylist() if len(used) else [], strict=True))
            phrases = [b" ".join([text_of[i] for i in row[:k]]).decode() for row, k in zip(keys[at].tolist(), level.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(at), pa.string()), pa.array(phrases, pa.string()), pa.array(times)], names=["lang", "phrase", "f"])

        for b in batches:
            for i in range(b.num_rows):
                group = tuple(b.column(c)[i].as_py() for c in range(3))
                if group != now:
                    if held:
                        yield flush()
                    now, held = group, []
                held.append(tuple(b.column(c)[i].as_py() for c in range(3, 7)))
        if held:
            yield flush()

    routed = texts_of(docs, text, lang).mapInArrow(route, "bucket bigint, lang string, lead int, n int, times binary, lengths binary, words binary")
    routed = routed.repartition(min(buckets, TASKS), "bucket").sortWithinPartitions("bucket", "lang", "lead")
    counted = routed.mapInArrow(count, "lang string, phrase string, f bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def part(words: Column, start: object, n: object) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(
    spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = 3, least: int = 10, share: int = 50, top: int = 2000, scale: int = 1000000
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``depth`` words.

    Texts are lower-cased in A-Z and split at ``.,;:!?`` and line ends into pieces, these at blanks
    and tabs into words.  ``n`` counts a language's words, ``a`` a phrase's occurrences inside
    pieces, overlapping ones too; ``least`` or more make it a candidate.  ``l`` and ``r`` count the
    two parts of the phrase at its lowest-scoring cut (ties: the shorter first part), where
    score = floor(scale * a * a / (l * r)).  A candidate that lies inside a longer one with at
    least ``share`` hundredths of its occurrences is dropped, whether or not the longer one is.
    Ranks go by score and count, both descending, and phrase.

    Null languages are ``und``; null and empty texts have no words; texts of any length are read
    whole, in slices that end with a piece; repeated rows and null keys count like others; other
    columns are ignored; an empty table gives none.  Counts below 10^15 are exact.
    """
    words, _ = cut(spark, word_counts(docs, text, lang))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    longer, _ = cut(spark, phrase_counts(docs, hot_words(words, total), buckets, depth, least, text, lang))
    counts = words.where(F.col("f") >= least).unionByName(longer)
    ws = F.split("phrase", " ")
    cand = longer.select("lang", "phrase", F.col("f").alias("a"), ws.alias("ws"))
    # every cut of every candidate meets the counts of its two parts
    at = F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k")
    cuts = cand.select("lang", "phrase", "a", "ws", at).select("lang", "phrase", "a", "k", part(F.col("ws"), 1, F.col("k")).alias("head"), part(F.col("ws"), F.col("k") + 1, F.size("ws")).alias("tail"))
    cuts, _ = cut(spark, cuts)
    of = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts, _ = cut(spark, join_spread(spark, cuts, of("head", "l"), ["lang", "head"]))
    cuts = join_spread(spark, cuts, of("tail", "r"), ["lang", "tail"])
    # floor of an exact quotient: 38 digits hold scale * a * a and l * r
    score = F.expr(f"(cast({scale} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    # of each phrase inside longer candidates, the most frequent of these
    span = F.explode(F.expr("filter(flatten(transform(sequence(1, size(ws)), s -> transform(sequence(1, size(ws)), m -> struct(s as s, m as m)))), x -> x.m >= 2 and x.m < size(ws) and x.s + x.m - 1 <= size(ws))")).alias("x")
    inside = cand.where(F.size("ws") > 2).select("lang", "a", "ws", span).select("lang", part(F.col("ws"), F.col("x.s"), F.col("x.m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # a language's best among the best of its salted groups
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
