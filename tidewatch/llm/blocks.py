"""Blocks: vectors packed so that one row holds some thousand ids and their vectors as bytes, and handfuls of texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
#: Documents, and bytes of text, that are handled together, about.
DOCS_TOGETHER, BYTES_TOGETHER = 512, 1 << 22


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), dtype)


def pack(vectors: DataFrame, dtype: str, extra: str | None = None, rows: int = BLOCK) -> DataFrame:
    """``(n, ids, vecs, extra)`` blocks of ``vectors(id, vec[, extra])``, made where the rows lie; equal lengths share a block."""

    def block(ids: np.ndarray, vecs: np.ndarray, more: np.ndarray | None) -> pa.RecordBatch:
        cols = [pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([vecs.tobytes()]), pa.array([None if more is None else more.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["n", "ids", "vecs", "extra"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                new = [part.column(0).to_numpy(), matrix(part.column(1), dtype), part.column(2).to_numpy(zero_copy_only=False) if extra else np.empty(len(part))]
                held[d] = [np.concatenate(x) for x in zip(held[d], new, strict=True)] if d in held else new
                while len(held[d][0]) >= rows:
                    yield block(held[d][0][:rows], held[d][1][:rows], held[d][2][:rows] if extra else None)
                    held[d] = [x[rows:] for x in held[d]]
        for ids, vecs, more in held.values():
            if len(ids):
                yield block(ids, vecs, more if extra else None)

    return vectors.select("id", "vec", *([F.col(extra)] if extra else [])).mapInArrow(run, "n int, ids binary, vecs binary, extra binary")


def usable(vec: str = "vec", zero: bool = True) -> object:
    """Whether a vector is not null, not empty, and holds neither null nor a number that isn't finite (nor, with ``zero`` false, only zeros)."""
    c = F.col(vec).cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = c.isNotNull() & (F.size(c) > 0) & fine
    return ok if zero else ok & F.exists(c, lambda x: x != 0)


def one_each(df: DataFrame, id: str, vec: str, zero: bool = True) -> DataFrame:
    """``(id, vec)`` of the usable rows; an id that occurs more than once keeps its smallest vector, a null id takes no part."""
    return df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec")).where(usable("vec", zero)).groupBy("id").agg(F.min("vec").alias("vec"))


def handfuls(b: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of bounded rows and, but for single texts that are longer, bounded text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        limit = (int(ends[at - 1]) if at else 0) + BYTES_TOGETHER
        stop = min(max(int(np.searchsorted(ends, limit, side="right")), at + 1), at + DOCS_TOGETHER)
        yield b.slice(at, stop - at)
        at = stop
