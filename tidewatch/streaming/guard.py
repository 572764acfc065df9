"""Online conformal guards: one state machine, run over whole tables or as Structured Streaming state.

Scores of an entity are taken in order of ``t``; a row whose ``t`` is not beyond the last one taken is
dropped, so a repeated row counts once.  A stream either takes each micro-batch as it comes, sorted,
or waits with each row until the watermark has passed its event time, so that late rows find their
place; rows later than the watermark are dropped.  One entity is one sequence of steps and so one
task, whatever its length; entities spread.  A score that is null or not finite is an error, as is an
entity without calibration scores or a score without ``t``; a row with neither is a heartbeat, which
only moves the watermark.  In a stream the guards of a group of entities are one state.
"""

import bisect
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import NumericType

OUT = "t long, s double, p_value double, threshold double, flag boolean, drift boolean, n_alarms long, n_seen long"
STATS = "n_calibration long, level double, fixed_threshold double, rolling_threshold double, n_alarms long, n_predictions long, far double, drift boolean"
#: What a guard remembers beside its buffer, behind the length of that; NaN is no rolling threshold, and none seen is no status.
KEPT = np.dtype([("size", "<i4"), ("rolling", "<f8"), ("drift", "?"), ("level", "<f8"), ("alarms", "<i8"), ("seen", "<i8"), ("last", "<i8")])
EPS = 1e-10
#: Entities that share a call of Python, a state and a timer in a stream; and rows of their output that go on together.
GROUP, OUT_ROWS = 128, 10_000
#: Kinds of the columns of waiting rows: number of the entity, event time in ms, t, s.
WAITING = ("<i4", "<i8", "<i8", "<f8")
#: Bits of ``nulls__``.
NO_KEY, NO_T, NO_S = 4, 2, 1


def order_statistic(xs: list | np.ndarray, alpha: float) -> float:
    n = len(xs)
    return float(xs[min(max(math.ceil((n + 1) * (1 - alpha)) - 1, 0), n - 1)])


class Guard:
    """``mode``: fixed, rolling (buffer of quiet scores, plain scale) or aci (buffer of all, z-scale, adaptive level).

    The level is shared between ``n_tests`` (Bonferroni).  Until the buffer is filled, and in drift, the
    threshold is that of the calibration scores at the present level.
    """

    def __init__(
        self, cal: list[float] | np.ndarray, mode: str, alpha: float = 0.05, window: int = 100, drift_sigma: float = 3.0, gamma: float = 0.01, n_tests: int = 1,
        buffer: list[float] = (), status: tuple | None = None,
    ):
        self.cal = np.sort(np.asarray(cal, float))
        if not len(self.cal) or not np.isfinite(self.cal).all():
            raise ValueError("calibration scores must be there and finite")
        self.mode, self.alpha, self.window, self.drift_sigma, self.gamma, self.n_tests = mode, alpha, window, drift_sigma, gamma, n_tests
        self.mu, self.sd = float(self.cal.mean()), float(self.cal.std())
        if mode == "aci":
            self.cal = (self.cal - self.mu) / (self.sd + EPS)
        self.buffer, self.ordered = deque(buffer), sorted(buffer)
        self.rolling, self.drift, self.level, self.alarms, self.seen, self.last = status or (None, False, alpha, 0, 0, None)

    def status(self) -> tuple:
        return self.rolling, self.drift, self.level, self.alarms, self.seen, self.last

    def effective(self) -> float:
        return min(1 - EPS, max(EPS, self.level / self.n_tests))

    def plain(self, x: float) -> float:
        """A threshold on the scale of the scores."""
        return x * (self.sd + EPS) + self.mu if self.mode == "aci" else x

    def remember(self, x: float) -> None:
        self.buffer.append(x)
        bisect.insort(self.ordered, x)
        if len(self.buffer) > self.window:
            del self.ordered[bisect.bisect_left(self.ordered, self.buffer.popleft())]
        n = len(self.buffer)
        if n >= max(10, self.window // 10):
            self.rolling = order_statistic(self.ordered, self.effective())
            mean = math.fsum(self.buffer) / n
            off = abs(mean) if self.mode == "aci" else abs(mean - self.mu) / max(self.sd, EPS)
            self.drift = off > self.drift_sigma

    def see(self, t: int, raw: float) -> tuple | None:
        if not math.isfinite(raw):
            raise ValueError(f"a score must be finite, not {raw} (t = {t})")
        if self.last is not None and t <= self.last:
            return None
        self.last = t
        x = (raw - self.mu) / (self.sd + EPS) if self.mode == "aci" else raw
        p = (1 + len(self.cal) - int(np.searchsorted(self.cal, x, side="left"))) / (len(self.cal) + 1)
        use = self.rolling if self.mode != "fixed" and self.rolling is not None and not self.drift else order_statistic(self.cal, self.effective())
        flag = x > use
        if self.window > 0 and (self.mode == "aci" or (self.mode == "rolling" and not flag)):
            self.remember(x)
        if self.mode == "aci":  # last: this score's error counts from the next one on
            self.level = min(1 - EPS, max(EPS, self.level + self.gamma * (self.alpha - flag)))
        self.alarms += int(flag)
        self.seen += 1
        return t, raw, p, self.plain(use), bool(flag), bool(self.drift), self.alarms, self.seen

    def stats(self) -> tuple:
        fixed = self.plain(order_statistic(self.cal, self.effective()))
        rolling = None if self.rolling is None else self.plain(self.rolling)
        return len(self.cal), self.level, fixed, rolling, self.alarms, self.seen, self.alarms / max(1, self.seen), bool(self.drift)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def schema_of(df: DataFrame, key: str, rest: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}, {rest}"


def seen_rows(guard: Guard, ts: list[int], ss: list[float], key: str, value: object) -> pd.DataFrame:
    """The guard's rows of steps in order."""
    out = pd.DataFrame([r for t, s in zip(ts, ss, strict=True) if (r := guard.see(int(t), float(s))) is not None], columns=names(OUT))
    out.insert(0, key, value)
    return out


def real_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """All but heartbeats; a score without t has no place in the order."""
    pdf = pdf[pdf["t"].notna() | pdf["s"].notna()]
    if pdf["t"].isna().any():
        raise ValueError("a score without t has no place in the order")
    return pdf


def guard_batch(df: DataFrame, cal: DataFrame, key: str = "entity", mode: str = "rolling", **options: float) -> DataFrame:
    """The guard over a whole table, an entity at a time in order of t; calibration scores meet their entity once."""

    kind = schema_of(df, key, OUT)

    def run(rows: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
        rows = real_rows(rows).sort_values(["t", "s"])
        if rows.empty:
            return pd.DataFrame(columns=names(kind))
        if scores.empty:
            raise ValueError(f"no calibration scores of {rows[key].iloc[0]}")
        return seen_rows(Guard(scores["s__c"].to_numpy(), mode, **options), rows["t"].tolist(), rows["s"].tolist(), key, rows[key].iloc[0])

    return df.select(key, "t", "s").groupBy(key).cogroup(cal.select(F.col(key).alias(f"{key}__c"), F.col("s").alias("s__c")).groupBy(f"{key}__c")).applyInPandas(run, kind)


class GuardState(StatefulProcessor):
    """The guards of a group of entities as typed state of a stream: calibration scores, buffers and status, and rows that wait for the watermark.

    A group's entities are numbered in the order of ``cal``, and ``guards`` lies in the same order.  Each row of state
    that Python reads costs more than a step of a guard, so a group has one for its guards, one a piece of its initial
    state, and one a piece of input for waiting rows, kept as they came: entities' numbers, event times, ``t`` and ``s``.
    """

    def __init__(self, key: str, kind: str, mode: str, options: dict, event_time: str | None, stats: bool):
        self.key, self.kind, self.mode, self.options, self.event_time, self.stats = key, kind, mode, options, event_time, stats

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cal = handle.getListState("cal", f"entity array<{self.kind}>, size binary, scores binary")
        self.guards = handle.getValueState("guards", "buffers binary, kept binary")
        self.waiting = handle.getListState("waiting", "who binary, ms binary, t binary, s binary")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        if initialState.empty:
            return
        scores = [np.sort(np.asarray(x, float)) for x in initialState["s"]]  # each entity in one piece
        self.cal.appendValue((entities(initialState), np.array([len(x) for x in scores], "<i4").tobytes(), np.concatenate(scores).tobytes()))

    def calibration(self) -> list[tuple]:
        """The group's entities, each with its calibration scores."""
        return [x for entity, size, scores in self.cal.get() for x in zip(entity, cut(scores, np.frombuffer(bytes(size), "<i4")), strict=True)]

    def take(self, cal: list[tuple], who: np.ndarray, ts: np.ndarray, ss: np.ndarray) -> Iterator[pd.DataFrame]:
        """Steps go through the guards of their entities, in order, and the state is kept."""
        if not len(who):
            return
        order = np.lexsort((ss, ts, who))
        who, ts, ss = who[order], ts[order], ss[order]
        before = self.guards.get()
        kept = np.zeros(len(cal), KEPT) if before is None else np.frombuffer(bytes(before[1]), KEPT).copy()
        buffers = cut(b"" if before is None else before[0], kept["size"])
        bounds = [0, *(np.flatnonzero(np.diff(who)) + 1).tolist(), len(who)]
        rows: list[tuple] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            n = int(who[a])
            entity, scores = cal[n]
            _, rolling, *rest = kept[n].item()
            status = (None if math.isnan(rolling) else rolling, *rest) if kept[n]["seen"] else None
            guard = Guard(scores, self.mode, buffer=buffers[n].tolist(), status=status, **self.options)
            seen = [(entity, *r) for t, s in zip(ts[a:b].tolist(), ss[a:b].tolist(), strict=True) if (r := guard.see(t, s)) is not None]
            buffers[n] = np.array(guard.buffer, float)
            rolling, *rest = guard.status()
            kept[n] = (len(guard.buffer), math.nan if rolling is None else rolling, *rest)
            rows += [(entity, *guard.stats())] if self.stats else seen
            if len(rows) >= OUT_ROWS:
                yield self.frame(rows)
                rows = []
        self.guards.update((np.concatenate(buffers).tobytes(), kept.tobytes()))
        if rows:
            yield self.frame(rows)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, *names(STATS if self.stats else OUT)], dtype=object)  # whole numbers beside nulls stay whole

    def arrived(self, pdf: pd.DataFrame, number: dict) -> pd.DataFrame:
        """All but heartbeats, with the numbers of their entities."""
        pdf = pdf[pdf["nulls__"] & (NO_T | NO_S) != (NO_T | NO_S)]
        if (pdf["nulls__"] & NO_T).any():
            raise ValueError("a score without t has no place in the order")
        keys = entities(pdf)
        if unknown := set(keys) - number.keys():
            raise ValueError(f"no calibration scores of {unknown.pop()}")
        return pdf.assign(who=np.array([number[k] for k in keys], np.int32))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        cal = self.calibration()
        number = {e: n for n, (e, _) in enumerate(cal)}
        pieces = [p for pdf in rows if len(p := self.arrived(pdf, number))]
        if not pieces:
            return
        if self.event_time is None:
            pdf = pd.concat(pieces)
            yield from self.take(cal, pdf["who"].to_numpy(), pdf["t"].to_numpy(), pdf["s"].to_numpy())
            return
        first = None
        for pdf in pieces:
            ms = -(-pdf["us__"].to_numpy(np.int64) // 1000)  # rounds up, so that a timer never fires before its row's time
            self.waiting.appendValue(as_bytes(pdf["who"].to_numpy(), ms, pdf["t"].to_numpy(), pdf["s"].to_numpy()))
            first = int(ms.min()) if first is None else min(first, int(ms.min()))
        if first < min(self.handle.listTimers(), default=first + 1):
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(np.frombuffer(bytes(x), kind) for x, kind in zip(piece, WAITING, strict=True)) for piece in self.waiting.get()]
        if not held:
            return
        who, ms, ts, ss = (np.concatenate(column) for column in zip(*held, strict=True))
        due = ms <= now
        if due.all():
            self.waiting.clear()
        else:
            self.handle.registerTimer(int(ms[~due].min()))
            if due.any():
                self.waiting.put([as_bytes(who[~due], ms[~due], ts[~due], ss[~due])])
        if due.any():
            yield from self.take(self.calibration(), who[due], ts[due], ss[due])

    def close(self) -> None:
        pass


def as_bytes(*columns: np.ndarray) -> tuple:
    """Columns of waiting rows as state."""
    return tuple(np.ascontiguousarray(x, kind).tobytes() for x, kind in zip(columns, WAITING, strict=True))


def cut(xs: bytes, size: np.ndarray) -> list[np.ndarray]:
    """Doubles kept one behind the other, in parts of these sizes."""
    return np.split(np.frombuffer(bytes(xs)), np.cumsum(size)[:-1])


def entities(pdf: pd.DataFrame) -> list:
    """The keys of rows, None where they are null."""
    return [None if null else k for k, null in zip(pdf["key__"].tolist(), (pdf["nulls__"] & NO_KEY != 0).tolist(), strict=True)]


def whole(df: DataFrame, c: str) -> Column:
    """A column without nulls if it holds numbers, which pandas would else take as floats."""
    kind = df.schema[c].dataType
    return F.coalesce(F.col(c), F.lit(0).cast(kind)) if isinstance(kind, NumericType) else F.col(c)


def guard_stream(
    stream: DataFrame, cal: DataFrame, key: str = "entity", mode: str = "rolling", event_time: str | None = None, stats: bool = False, groups: int | None = None, **options: float
) -> DataFrame:
    """The same guard over a stream; calibration scores are its initial state, given once a key.

    With ``event_time``, a column that has a watermark, rows wait for it and come out in order of t;
    else each micro-batch is sorted by itself.  ``stats`` gives, in update mode, a row of running
    statistics a key and micro-batch instead.  The state store is RocksDB, which typed state needs.

    Python, state and timers are called once a micro-batch for a group of entities, not for each.
    ``groups`` is their number, by default one for every ``GROUP`` entities of ``cal``, or more on
    many cores; a stream that goes on from a checkpoint must be given the number it began with.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind, none = stream.schema[key].dataType, F.lit(float("nan"))
    first = cal.select(F.col(key).cast(kind).alias(key), F.coalesce(F.col("s").cast("double"), none).alias("s")).groupBy(key).agg(F.collect_list("s").alias("s"))
    groups = groups or max(-(-first.count() // GROUP), 4 * spark.sparkContext.defaultParallelism)
    group = F.pmod(F.xxhash64(key), F.lit(groups)).alias("group__")
    null = lambda c, bit: F.when(F.col(c).isNull(), bit).otherwise(0)
    initial = first.select(group, whole(first, key).alias("key__"), null(key, NO_KEY).alias("nulls__"), "s")
    rows = stream.select(
        group, whole(stream, key).alias("key__"), (null(key, NO_KEY) + null("t", NO_T) + null("s", NO_S)).alias("nulls__"), whole(stream, "t").cast("long").alias("t"), F.coalesce(F.col("s").cast("double"), none).alias("s"),
        *([event_time, F.unix_micros(event_time).alias("us__")] if event_time else []),
    )
    return rows.groupBy("group__").transformWithStateInPandas(
        GuardState(key, kind.simpleString(), mode, options, event_time, stats), schema_of(stream, key, STATS if stats else OUT), "update" if stats else "append", "eventtime" if event_time else "none",
        initialState=initial.groupBy("group__"),
    )


def stream_fixed(stream: DataFrame, thresholds: DataFrame, key: str = "entity") -> DataFrame:
    """Stateless flags against a static table of thresholds; works on a table or a stream."""
    return stream.join(thresholds, key).withColumn("flag", F.col("s") > F.col("thr"))


def guard_stats(flags: DataFrame, key: str = "entity") -> DataFrame:
    """Alarms, predictions and the empirical rate of each entity; on a stream, an aggregate for update mode."""
    return flags.groupBy(key).agg(F.sum(F.col("flag").cast("long")).alias("n_alarms"), F.count("*").alias("n_predictions"), F.avg(F.col("flag").cast("double")).alias("far"))


def quadratic(f: Column, mu: Column, prec: Column) -> Column:
    """The squared Mahalanobis distance of a vector, never below 0, as an expression."""
    d = F.zip_with(f, mu, lambda a, b: a - b)
    rows = F.transform(prec, lambda row: F.aggregate(F.zip_with(row, d, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x))
    return F.greatest(F.lit(0.0), F.aggregate(F.zip_with(d, rows, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))


def stream_score(stream: DataFrame, model: DataFrame, key: str = "entity") -> DataFrame:
    """Adds ``s``, the distance of each arriving vector ``f`` to its key's model ``mu, prec``; stateless.

    The model is a static table of one row a key that meets the stream in a join; no Python runs.
    """
    joined = stream.join(model.select(key, "mu", "prec"), key)
    return joined.withColumn("s", quadratic(F.col("f"), F.col("mu"), F.col("prec"))).drop("mu", "prec")
