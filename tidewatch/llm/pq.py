"""Vector codes: product quantisation whose codebooks are fitted by ball k-means, in whole numbers.

The state of a fit is a table of blocks, each some thousand vectors with the code of each part.  A
round reads it once: every part moves from its present entry to its nearest one, by looking only at
entries that can be nearer.  With own squared distance o to entry i and squared distance d between
entries i and j, entry j can only be as near if d <= 4 * o.  So the ball of entry i, with the largest
o of its parts as radius, has as neighbours the entries with d <= 4 * radius; parts in its stable
core (4 * o below the nearest neighbour's d) are done without any look; and the others lie in rings,
where the ring between the m-th and the next neighbour needs the first m neighbours only.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.blocks import matrix, usable
from tidewatch.llm.scratch import cut, drop

#: Vectors of a block.
ROWS = 8192
STATE = "n int, keys binary, vecs binary, codes binary, sums binary"


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("...i,...i->...", d, d)


def ball_assign(x: np.ndarray, code: np.ndarray, book: np.ndarray, looks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries (ties to the lower index) and squared distances of the rows of ``x``, which are now in the balls ``code``.

    ``looks``, if given, gets added the numbers of rows, of rows in a stable core, and of distances
    computed to other entries.
    """
    n = len(book)
    own = squares(x, book[code])
    between = squares(book[:, None], book[None])
    np.fill_diagonal(between, -1)
    order = np.argsort(between, axis=1, kind="stable")[:, 1:]  # other entries, nearest first
    apart = np.take_along_axis(between, order, 1)
    radius = np.zeros(n, own.dtype)
    np.maximum.at(radius, code, own)
    neighbours = (apart <= 4 * radius[:, None]).sum(axis=1)
    outside = np.flatnonzero(4 * own >= apart[code, 0]) if n > 1 else np.empty(0, np.int64)
    code, own = code.copy(), own.copy()
    ball, reach = code[outside], 4 * own[outside]
    best, least = ball.copy(), own[outside]
    rings = np.zeros(len(outside), np.int64)  # how many neighbours each part must look at
    most = int(neighbours.max(initial=0))
    for k in range(most):
        rings += apart[ball, k] <= reach
    for k in range(most):
        rows = np.flatnonzero(rings > k)
        if not len(rows):
            break
        j = order[ball[rows], k]
        d = squares(x[outside[rows]], book[j])
        nearer = (d < least[rows]) | (d == least[rows]) & (j < best[rows])
        rows, j, d = rows[nearer], j[nearer], d[nearer]
        best[rows], least[rows] = j, d
    if looks is not None:
        looks += [len(x), len(x) - len(outside), rings.sum()]
    code[outside], own[outside] = best, least
    return code, own


def exact_type(width: int, *arrays: np.ndarray) -> type:
    """A type in which sums of ``width`` squared differences are exact; an error where 64 bits may not hold a vector's."""
    top = 2 * max(int(np.abs(a).max(initial=0)) if a.dtype.kind != "i" or not (a == np.iinfo(a.dtype).min).any() else 1 << 63 for a in arrays)
    if top * top * width >= 1 << 62:
        raise ArithmeticError(f"components of {top // 2} after scaling: squared distances may pass 64 bits")
    return np.float64 if 4 * top * top * width < 1 << 53 else np.int64


def opened(b: pa.RecordBatch, i: int, width: int, parts: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    n = b.column(0)[i].as_py()
    vecs = np.frombuffer(b.column(2)[i].as_buffer(), np.int64 if len(b.column(2)[i].as_buffer()) == 8 * n * width else np.int32)
    return b.column(1)[i].as_py(), vecs.reshape(n, parts, width // parts), np.frombuffer(b.column(3)[i].as_buffer(), np.uint8).reshape(n, parts)


def assigned(vecs: np.ndarray, codes: np.ndarray, book: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Codes and squared distances of all parts; a part position whose codebook is as before keeps its codes, with no distances."""
    kind = exact_type(vecs.shape[1] * vecs.shape[2], vecs, book)
    out, own = codes.copy(), np.zeros(codes.shape, np.int64)
    for p in range(vecs.shape[1]):
        if before is None or not np.array_equal(book[p], before[p]):
            out[:, p], own[:, p] = ball_assign(np.ascontiguousarray(vecs[:, p]).astype(kind), codes[:, p], book[p].astype(kind))
    return out, own


def part_sums(vecs: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """``(parts, entries, width + 1)``: sums of the parts of each entry, and their number."""
    n, parts, width = vecs.shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        order = np.argsort(codes[:, p], kind="stable")
        code = codes[order, p]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if n else np.empty(0, np.int64)
        if n:
            out[p, code[at], :width] = np.add.reduceat(vecs[order, p].astype(np.int64), at)
            out[p, code[at], width] = np.diff(np.append(at, n))
    return out


def fit_codes(
    spark: SparkSession, rows: DataFrame, id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error)`` of every usable vector, and the final codebooks ``(parts, entries, width of a part)``.

    A component x counts as floor(scale * x).  The codebooks start as the parts of the ``entries``
    vectors of smallest id (equal ids by vector, null ids last; as many entries as there are vectors,
    if fewer), at most 256.  ``code`` is one byte a part, ``error`` the sum of squared distances.

    Vectors that are null, empty, or hold null or a number that is not finite take no part, nor do
    those whose length is not that of the smallest id's, or cannot be cut into equal parts.
    Repeated rows and rows with null ids or labels are rows like others; other columns are ignored;
    an empty table gives none, and no codebook entries.  Numbers so large that 64 bits may not hold
    a squared distance are an error.  The driver holds the codebooks and one number for each of
    their components, whatever the table.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    kinds = [rows.schema[c].dataType.simpleString() for c in (id, label)]
    whole = F.transform(F.col(vec), lambda x: F.floor(x.cast("double") * scale))
    good = rows.where(usable(vec) & (F.size(vec) % parts == 0)).select(F.col(id).alias("id"), F.col(label).alias("label"), whole.alias("vec"))
    first = good.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], f"id {kinds[0]}, label {kinds[1]}, code binary, error bigint"), np.empty((parts, 0, 0), np.int64)
    width = len(first[0]["vec"])
    book = np.array([r["vec"] for r in first if len(r["vec"]) == width], np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    if len(first) > book.shape[1]:  # some of the smallest ids have another length
        first = good.where(F.size("vec") == width).orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
        book = np.array([r["vec"] for r in first], np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                vecs = matrix(b.column(2), "int64")
                exact_type(width, vecs)
                small = vecs.astype(np.int32)
                vecs = small if (small == vecs).all() else vecs
                sink = pa.BufferOutputStream()
                keys = b.select(["id", "label"])
                with pa.ipc.new_stream(sink, keys.schema) as w:
                    w.write_batch(keys)
                raw = [pa.array([len(vecs)], pa.int32()), *[pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), vecs.tobytes(), bytes(len(vecs) * parts), None)]]
                yield pa.RecordBatch.from_arrays(raw, names=["n", "keys", "vecs", "codes", "sums"])

    def step(now: np.ndarray, before: np.ndarray | None) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    _, vecs, codes = opened(b, i, width, parts)
                    codes, _ = assigned(vecs, codes, now, before)
                    sums = part_sums(vecs, codes, now.shape[1])
                    new = [b.column(c).slice(i, 1) for c in range(3)] + [pa.array([codes.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(new, names=["n", "keys", "vecs", "codes", "sums"])

        return run

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for x in b.column(0):
                total = total + np.frombuffer(x.as_buffer(), np.int64)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "total"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, vecs, codes = opened(b, i, width, parts)
                codes, own = assigned(vecs, codes, book, None)
                ids = pa.ipc.open_stream(keys).read_all().combine_chunks().to_batches()[0]
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), code, pa.array(own.sum(axis=1))], names=["id", "label", "code", "error"])

    state, path = cut(spark, good.where(F.size("vec") == width).mapInArrow(blocks, STATE))
    before = None
    for _ in range(rounds):
        after, new = cut(spark, state.mapInArrow(step(book, before), STATE))
        drop(spark, path)  # the next state is whole in the shared folder
        state, path = after, new
        found = state.select("sums").mapInArrow(totals, "at bigint, total bigint").groupBy("at").agg(F.sum("total").alias("total")).collect()
        sums = np.zeros(parts * book.shape[1] * (width // parts + 1), np.int64)
        for r in found:
            sums[r["at"]] = r["total"]
        sums = sums.reshape(parts, book.shape[1], -1)
        before, count = book, sums[:, :, -1:]
        book = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), book)
    return state.mapInArrow(last, f"id {kinds[0]}, label {kinds[1]}, code binary, error bigint"), book


def book_digest(book: np.ndarray) -> str:
    """SHA-256, in hex, of all components as decimal numbers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def decoded(code: bytes, book: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in scaled whole numbers."""
    return np.concatenate([book[p, c] for p, c in enumerate(code)])

