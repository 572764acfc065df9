"""SimHash near copies: blocking on fingerprint bits, pivot distance tables, verification, connected components.

A fingerprint is an array of 64-bit words.  Its pivot table holds its Hamming distances to fixed
reference fingerprints and is made once, beside it.  Fingerprints that share a blocking key meet in
a run sorted by the first pivot's distance; by the triangle inequality two of them within the radius
differ by no more than it in every column, so a pair is looked at only inside that window, discarded
by its largest coordinate difference, and verified on the fingerprints if it survives.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.scratch import cut, drop

#: Shingles hashed at a time, which bounds the memory that one very long text takes.
CHUNK = 1 << 15
#: Reference fingerprints of the distance tables.
N_PIVOTS = 16
#: Width of a cell of the first pivot's distances, into which runs are split; cells overlap by the radius.
CELL = 8

# ---------------------------------------------------------------- fingerprints


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """The bits that over half of the hashes set; further words mix each hash anew."""
    out = np.zeros(words, np.uint64)
    for w in range(words):
        total = np.zeros(64, np.int64)
        for i in range(0, len(hashes), CHUNK):
            h = hashes[i : i + CHUNK] if w == 0 else mixed(hashes[i : i + CHUNK] + np.uint64(w * int(GOLDEN) % (1 << 64)))
            total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[w] = int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the lower-cased words' shingles; 0 without words; a bit is set if over half the hashes set it."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
FIRST, SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * FIRST
    h = (h ^ (h >> np.uint64(29))) * SECOND
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased words' shingles; all words are one shingle of a shorter text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    of = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    h = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * GOLDEN + h[i : len(words) - width + 1 + i])
    return np.unique(out)


def pivots(words: int, n: int = N_PIVOTS) -> np.ndarray:
    """``n`` fixed pseudo-random fingerprints."""
    return np.random.default_rng(20240607).integers(0, 1 << 63, (n, words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance_table(fp: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hamming distances of each row of ``fp`` to each pivot, as bytes: one of 256 counts as 255, which only lessens differences."""
    return np.stack([np.minimum(np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16), 255).astype(np.uint8) for p in to], axis=1) if len(fp) else np.empty((0, len(to)), np.uint8)


# ---------------------------------------------------------------- blocking keys


def exact_masks(blocks: int, distance: int) -> np.ndarray:
    """Masks of one word, of which two fingerprints at most ``distance`` bits apart agree under one at least.

    The 64 bits fall into ``blocks`` parts; at most ``distance`` of them differ, so that some choice
    of ``blocks - distance`` parts agrees wholly.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return np.array([[sum((1 << edges[p + 1]) - (1 << edges[p]) for p in parts)] for parts in combinations(range(blocks), blocks - distance)], np.uint64)


def sampled_masks(words: int, bits: int, n: int) -> np.ndarray:
    """``n`` masks of ``bits`` bits of a fingerprint, chosen by a fixed seed."""
    rng = np.random.default_rng(20240901)
    out = np.zeros((n, words), np.uint64)
    for row in out:
        for b in rng.choice(64 * words, bits, replace=False).tolist():
            row[b // 64] |= np.uint64(1 << (b % 64))
    return out


def masks_for(alike: float, words: int, bits: int, missed: float) -> np.ndarray:
    """As many sampled masks as a pair of Jaccard similarity ``alike`` needs to agree under one, but for a share ``missed``.

    The fingerprints of two sets agree in a bit with probability 1 - angle / pi, the angle being
    that between their indicator vectors.
    """
    agree = 1 - np.arccos(2 * alike / (1 + alike)) / np.pi
    return sampled_masks(words, bits, int(np.ceil(np.log(missed) / np.log1p(-(agree**bits)))))


# ---------------------------------------------------------------- pairs inside runs


def whole_runs(ends: np.ndarray, first: np.ndarray, fp: np.ndarray, table: np.ndarray, distance: int, window: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning set of links: within each run, the same components as all its near pairs.

    Rows are sorted by run and then by ``first``; ``ends[i]`` is the end of row i's run.  Every lag
    compares each row with the one so many places on while that one is in its window.  ``seen``, if
    given, gets the numbers of pairs compared, discarded by the pivots, and verified added to it.
    """
    n = len(fp)
    first, table = first.astype(np.int32), table.astype(np.int16)
    root = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def find(i: int) -> int:
        while root[i] != i:
            i = int(root[i])
        return i

    i, lag = np.arange(n), 1
    while True:
        i = i[i + lag < ends[i]]
        i = i[first[i + lag] - first[i] <= window]
        if not len(i):
            break
        j = i + lag
        pick = root[i] != root[j]
        a, b = i[pick], j[pick]
        near = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= distance
        if seen is not None:
            seen += [len(a), len(a) - near.sum(), near.sum()]
        a, b = a[near], b[near]
        good = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1) <= distance
        a, b = a[good], b[good]
        if len(a):
            joined = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(x), find(y)
                joined.append(x != y)
                root[max(x, y)] = min(x, y)
            out.append((a[joined], b[joined]))
            while (up := root[root]).tolist() != root.tolist():
                root[:] = up
        lag += 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def payload_type(words: int, n_pivots: int) -> np.dtype:
    """What goes with a node: its fingerprint, its pivot table, and the number that its runs are sorted by."""
    return np.dtype([("fp", np.uint64, (words,)), ("table", np.uint8, (n_pivots,)), ("first", np.int16)])


def as_binary(rows: np.ndarray) -> pa.Array:
    """Records of one size as a binary column."""
    raw, offsets = rows.tobytes(), np.arange(len(rows) + 1, dtype=np.int32) * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def of_binary(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def links(prints: DataFrame, masks: np.ndarray, distance: int, window: int, cell: int, n_pivots: int = N_PIVOTS) -> DataFrame:
    """Spanning links ``(u, v)`` of the distinct nodes of ``prints(node, payload)`` within ``distance``.

    Two nodes are compared if they agree under a mask and their ``first`` differs by ``window`` at
    most.  A node goes to one run a mask, in its cell of ``first`` and in the one below if that lies
    within the window: runs are split into cells, and no pair is lost.
    """
    kind = payload_type(masks.shape[1], n_pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                node, pay = b.column(0).to_numpy(), of_binary(b.column(1), kind)
                first = pay["first"].astype(np.int64)
                low = np.flatnonzero((first % cell < window) & (first >= cell))
                rows = np.concatenate([np.arange(len(pay)), low])
                where = np.concatenate([first // cell, first[low] // cell - 1]).astype(np.uint64)
                node, pay = pa.array(node[rows]), as_binary(pay[rows])
                fp = of_binary(pay, kind)["fp"]
                for m, mask in enumerate(masks):
                    run = mixed(where * GOLDEN + np.uint64(m))
                    for w in np.flatnonzero(mask).tolist():
                        run = mixed(run * GOLDEN + (fp[:, w] & mask[w]))
                    yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), node, pay], names=["run", "node", "payload"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # run, node, payload of the run that the batch's end may have cut

        def flush(run, node, pay):
            new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            size = np.diff(np.append(new, len(run)))
            order = np.lexsort((pay["first"], np.repeat(np.arange(len(new)), size)))
            node, pay = node[order], pay[order]
            a, b = whole_runs(np.repeat(new + size, size), pay["first"], pay["fp"], pay["table"], distance, window)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), of_binary(batch.column(2), kind)]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            other = cols[0] != cols[0][-1]
            at = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            held = [x[at:] for x in cols]
            if at:
                yield flush(*[x[:at] for x in cols])
        if held and len(held[0]):
            yield flush(*held)

    keyed = prints.select("node", "payload").mapInArrow(key, "run bigint, node bigint, payload binary")
    return keyed.repartition("run").sortWithinPartitions("run", "node").mapInArrow(meet, "u bigint, v bigint").distinct()


# ---------------------------------------------------------------- components


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges(u, v)``, root the component's smallest node; a table in the shared folder.

    Large-star and small-star steps alternate until the edges stay; every step is an aggregate and
    a join, and each round's edges are a table in the shared folder.
    """
    least, most = F.least("u", "v"), F.greatest("u", "v")
    now, path = cut(spark, edges.where("u <> v").select(least.alias("u"), most.alias("v")).distinct())
    state = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.least("m", "u").alias("u"), "v").distinct()
        # small star: of each node's smaller neighbours, the least takes the others
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        nxt, new = cut(spark, small.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        drop(spark, path)
        now, path = nxt, new
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == state:
            break
        state = tuple(row)
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def signed(docs: DataFrame, key: str, text: str, sign: Callable[[str | None], tuple[int, int, np.ndarray, int | None]], to: np.ndarray) -> DataFrame:
    """``(key, node, size, payload)`` of every row, from ``sign(text)``: node, size, fingerprint, and what runs are sorted by (None: the first pivot's distance); no shuffle."""
    kind = payload_type(to.shape[1], len(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sign(x.as_py()) for x in b.column(1)]
            pay = np.zeros(len(got), kind)
            pay["fp"] = np.array([g[2] for g in got], np.uint64).reshape(-1, to.shape[1])
            pay["table"] = distance_table(pay["fp"], to)
            pay["first"] = [t if g[3] is None else g[3] for g, t in zip(got, pay["table"][:, 0].tolist(), strict=True)]
            node = np.array([g[0] for g in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), pa.array([g[1] for g in got], pa.int64()), as_binary(pay)], names=["key", "node", "size", "payload"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, node bigint, size bigint, payload binary")


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 3, blocks: int = 6, width: int = 3) -> DataFrame:
    """``(key, fp, component)`` of every row: component is the smallest key reachable over links of fingerprints within ``distance`` bits.

    Null and empty texts have fingerprint zero and link like any other; texts of any length are
    read whole; exact copies meet in one aggregate and are never compared pairwise; rows with a
    null key keep their fingerprint and take the component of the others (null where all keys are);
    repeated rows stay; other columns are ignored; an empty table gives none.
    """

    def sign(text: str | None) -> tuple[int, int, np.ndarray, None]:
        fp = fingerprint(text, width)
        return fp, 0, np.array([fp], np.uint64), None

    prints, _ = cut(spark, signed(docs, key, text, sign, pivots(1)))
    groups = prints.groupBy("node").agg(F.min("key").alias("low"), F.first("payload").alias("payload"))
    found = components(spark, links(groups, exact_masks(blocks, distance), distance, distance, CELL)).withColumnRenamed("node", "n")
    rooted = groups.select("node", "low").join(found, F.col("node") == F.col("n"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    classes = rooted.join(lows, "root").select("node", "component")
    return prints.join(classes, "node").select("key", F.col("node").alias("fp"), "component")


# ---------------------------------------------------------------- one document of each group of near copies

#: The stage's fingerprints: 4 words.  At a similarity of 0.8 two of them differ in 39 of 256 bits on
#: average, with a standard deviation of 6; a pair within RADIUS is verified on its shingle sets.
WORDS, RADIUS = 4, 56
#: Bits sampled for a blocking key, and the share of pairs at the very threshold that may meet under none.
#: Runs of unlike texts stay short while this is near the binary logarithm of the number of texts.
BITS, MISSED = 14, 2e-4
#: Pivots of the stage's tables.
STAGE_PIVOTS = 4
#: Sizes of alike sets: hundredths of a natural logarithm, rounded down, and how many of these make a cell.
SIZE_STEPS, SIZE_CELL = 100, 400
#: Texts and shingles that one side of a verification holds, about.
TILE_TEXTS, TILE_SHINGLES = 256, 1 << 20


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every two of the sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    times = np.bincount(column) if len(column) else np.empty(0, np.int64)
    both = times[column] > 1  # an element of one set alone is common to no two
    renumber = np.cumsum(times > 1) - 1
    column, owner = renumber[column[both]], owner[both]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def alike_links(sets: list[np.ndarray], alike: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning set of the links between sets of Jaccard similarity ``alike`` or more."""
    size = np.array([len(s) for s in sets])
    common = shared_counts(sets)
    near = common >= alike * (size[:, None] + size[None, :] - common) - 1e-6
    root, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        for j in np.flatnonzero(near[i, :i] & (root[:i] != root[i])).tolist():
            if root[j] != root[i]:
                low, high = min(root[i], root[j]), max(root[i], root[j])
                root[root == high] = low
                out.append((j, i))
    return np.array([a for a, _ in out], np.int64), np.array([b for _, b in out], np.int64)


def verified(members: DataFrame, alike: float) -> DataFrame:
    """Spanning links ``(u, v)`` of similarity ``alike`` or more from ``members(cluster, tiles, node, shingles)``.

    A cluster's texts are dealt into tiles of bounded size; a task meets two tiles at a time, so that
    every two texts of a cluster meet and none holds a large cluster whole.
    """
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1))
    dealt = members.withColumn("tile", tile).withColumn("other", other)
    dealt = dealt.select("cluster", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def flush() -> pa.RecordBatch:
            i, j = alike_links(sets, alike)
            at = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at[i]), pa.array(at[j])], names=["u", "v"])

        for b in batches:
            for group, node, raw in zip(zip(*[b.column(i).to_pylist() for i in range(3)], strict=True), b.column(3).to_pylist(), b.column(4), strict=True):
                if group != now:
                    if len(nodes) > 1:
                        yield flush()
                    now, nodes, sets = group, [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw.as_buffer(), np.uint64))
        if len(nodes) > 1:
            yield flush()

    dealt = dealt.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "node")
    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def keep_one(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, alike: float = 0.8, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest that near copies reach, one row a key; rows without a key stay.

    Near copies are texts whose sets of ``width``-word shingles have a Jaccard similarity of ``alike``
    or more.  Fingerprints of those sets find clusters of candidates, and each link is verified on
    the whole sets; texts of equal sets meet in one aggregate.  Null and empty texts are copies of
    each other; texts of any length are read whole; repeated rows of one key are one; extra columns
    of any name stay; an empty table stays empty.
    """

    def sign(text: str | None) -> tuple[int, int, np.ndarray, int]:
        s = shingle_set(text, width)
        return xxhash.xxh64_intdigest(s.tobytes(), 42), len(s), majority(s, WORDS), int(np.log1p(len(s)) * SIZE_STEPS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(0)]
            node = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], node, pa.array([s.tobytes() for s in sets], pa.binary())], names=["cluster", "tiles", "node", "made", "shingles"])

    known = docs.where(F.col(key).isNotNull())
    prints, _ = cut(spark, signed(known, key, text, sign, pivots(WORDS, STAGE_PIVOTS)))
    groups = prints.groupBy("node").agg(F.min("key").alias("low"), F.first("size").alias("size"), F.first("payload").alias("payload"))
    # sets of this similarity differ by no more than its reciprocal in size
    window = int(-np.log(alike) * SIZE_STEPS) + 2
    found = components(spark, links(groups, masks_for(alike, WORDS, bits, MISSED), RADIUS, window, SIZE_CELL, STAGE_PIVOTS))
    near, _ = cut(spark, found.union(found.select("root", "root").distinct()).select(F.col("node").alias("n"), F.col("root").alias("cluster")))
    asked, _ = cut(spark, groups.select("node", "low", "size").join(near, F.col("node") == F.col("n")).drop("n"))
    tiles = asked.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum("size") / TILE_SHINGLES)).alias("tiles"))
    asked = asked.join(tiles, "cluster").select(F.col("low").alias("__low"), "cluster", "tiles", "node")
    texts = known.select(F.col(key).alias("__low"), F.col(text).alias("__text")).join(asked, "__low").select("__text", "cluster", "tiles", "node")
    members = texts.mapInArrow(whole, "cluster bigint, tiles bigint, node bigint, made bigint, shingles binary").where("node = made").dropDuplicates(["node"])
    roots = components(spark, verified(members, alike)).withColumnRenamed("node", "n")
    rooted = groups.select("node", "low").join(roots, F.col("node") == F.col("n"), "left").select("low", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("low").alias(key)).select(key).distinct()
    return known.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns).union(docs.where(F.col(key).isNull()))
