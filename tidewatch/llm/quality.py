"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.scratch import cut

#: The document classifier is fitted on so many labelled documents at most, chosen by a hash of their ids.
TRAIN_ROWS = 20_000
#: Bounds on how many documents a prior counts for.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 500.0
#: Paths whose table is sent to every task; more than that are joined by a shuffle.
MOST_SENT = 50_000
#: Evidence of one document is held within this many nats, so that no single text decides a site.
MOST_EVIDENCE = 12.0

UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SPACES = b" \t\n\r\x0b\x0c"
STOPS, SIGNS = b".,;:'()-", b"!#$%&*+/<=>@[\\]^_`{|}~"
FEATURES = ("log_bytes", "upper", "digit", "stops", "signs", "doubled", "word_length", "lines", "distinct", "top_word", "again", "any_word")
DOUBLED = re.compile(rb"([!#$%&*|=~_?-])\1")


def features(text: str | None) -> list[float]:
    """Shape of a text: shares of kinds of characters, word and line lengths, repetition; all zero for an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(raw)
    left = lambda drop: n - len(raw.translate(None, drop))
    letters = sum(map(len, words))
    size = len(words)
    counts = Counter(words)
    kinds, most = len(counts), max(counts.values())
    return [
        np.log1p(n) / 10, left(UPPER) / n, left(DIGITS) / n, left(STOPS) / size, left(SIGNS) / size, sum(1 for _ in DOUBLED.finditer(raw)) / size,
        letters / size / 10, np.log1p(size / (raw.count(b"\n") + 1)) / 5, np.log(kinds / size) / max(1.0, np.log(size)), most / size, sum(map(eq, words, words[1:])) / size, 1.0,
    ]


def feature_column(b: pa.Array) -> pa.Array:
    return pa.array([features(t) for t in b.to_pylist()], pa.list_(pa.float64()))


class Model:
    """Logistic regression on the features and their squares, by Newton steps with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = self.expand(x)
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            move = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
            w += move
            if np.abs(move).max() < 1e-8:
                break
        self.w, self.base = w, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))

    def expand(self, x: np.ndarray) -> np.ndarray:
        u = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), u, np.minimum(u * u, 16), np.abs(u)])

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad text: the logit without the training sample's prior."""
        return np.clip(self.expand(x) @ self.w - self.base, -MOST_EVIDENCE, MOST_EVIDENCE) if len(x) else np.empty(0)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def logit(c: Column) -> Column:
    return F.log(c / (1 - c))


def fit(features: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model | None:
    """The document classifier from at most TRAIN_ROWS labelled rows of ``features(key, f)``; None without both classes."""
    rows = features.join(labels.where(F.col("quality").isNotNull()).select(F.col(key).alias("key"), "quality"), "key").orderBy(F.xxhash64("key"), "key", "f").limit(TRAIN_ROWS).select("f", "quality").toPandas()
    if rows["quality"].nunique() < 2:
        return None
    return Model(np.stack(rows["f"].to_numpy()), (rows["quality"].to_numpy() > 0).astype(float))


def with_evidence(docs: DataFrame, model: Model | None, column: str, made: bool, name: str) -> DataFrame:
    """``docs`` with the evidence as column ``name``, from a text column, or from a feature column if it is ``made`` already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(b.schema.get_field_index(column))
            f = (c if made else feature_column(c)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            ev = model.evidence(f) if model else np.zeros(len(f))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ev)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def moment(n: str, s: str) -> Column:
    """Variance of a level's true means: that of the observed ones, weighted by their size, less what sampling gives.

    Groups of several documents count; p (1 - p) / (n - 1) estimates a group's sampling variance.
    """
    w = F.when(F.col(n) > 1, F.col(n))
    p = F.col(s) / F.col(n)
    observed = F.sum(w * p * p) / F.sum(w) - F.pow(F.sum(w * p) / F.sum(w), 2)
    return observed - F.sum(w * p * (1 - p) / (F.col(n) - 1)) / F.sum(w)


def strength(mean: float, variance: float | None) -> float:
    """Documents that a beta prior of this mean and variance counts for."""
    var = variance or 0.0
    return float(min(max(mean * (1 - mean) / var - 1 if var > 1e-9 else MOST_STRENGTH, LEAST_STRENGTH), MOST_STRENGTH))


class Sites:
    """What all documents say of their hosts and paths: a table of counts, the global mean and the strengths of the priors.

    ``table(__host, __path, __n, __s, __hn, __hs)`` has a row a path: its documents, the sum of their
    probabilities (each from its own evidence at even odds), and the same of its host.
    """

    def __init__(self, spark: SparkSession, scored: DataFrame):
        paths = scored.groupBy(F.col("host").alias("__host"), F.col("path").alias("__path")).agg(F.count("*").alias("__n"), F.sum(sigmoid(F.col("evidence"))).alias("__s"))
        paths, _ = cut(spark, paths)
        hosts = paths.groupBy(F.col("__host").alias("__h")).agg(F.sum("__n").alias("__hn"), F.sum("__s").alias("__hs"))
        total, n, spread = hosts.agg(F.sum("__hs"), F.sum("__hn"), moment("__hn", "__hs")).first()
        self.mean = min(max(total / n, 0.01), 0.99) if n else 0.5
        self.of_host = strength(self.mean, spread)
        self.of_path = strength(self.mean, paths.agg(moment("__n", "__s")).first()[0])
        self.table = paths.join(hosts, F.col("__host").eqNullSafe(F.col("__h"))).drop("__h")
        # a table of this many rows of two names and four numbers is small; beyond that both sides are shuffled
        if paths.count() <= MOST_SENT:
            self.table = F.broadcast(self.table)

    def prior(self, evidence: Column) -> Column:
        """Probability of good text at a document's path before its own evidence, which is left out of both levels.

        A host's other documents are shrunk toward the global mean, and a path's toward its host.
        """
        own = sigmoid(evidence)
        host = (F.col("__hs") - own + self.mean * self.of_host) / (F.col("__hn") - 1 + self.of_host)
        return (F.col("__s") - own + host * self.of_path) / (F.col("__n") - 1 + self.of_path)

    def beside(self, df: DataFrame, host: Column, path: Column) -> DataFrame:
        return df.join(self.table, host.eqNullSafe(F.col("__host")) & path.eqNullSafe(F.col("__path")))


def site_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> tuple[DataFrame, Sites, Model | None]:
    """Every row's ``(key, host, path, evidence)``, what is known of the sites, and the classifier."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), feature_column(b.column(3))], names=["key", "host", "path", "f"])

    some = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    made, _ = cut(spark, some.mapInArrow(run, f"key {kind}, host string, path string, f array<double>"))
    model = fit(made, labels, key)
    scored = with_evidence(made, model, "f", True, "evidence").drop("f")
    return scored, Sites(spark, scored), model


def combine(evidence: Column, prior: Column) -> Column:
    return sigmoid(evidence + logit(F.least(F.greatest(prior, F.lit(1e-4)), F.lit(1 - 1e-4))))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``(key, host, path, evidence, prior, posterior, keep)`` of every row; keep: a posterior of half or more.

    Null and empty texts have the features of no text, and their evidence follows the labels of such
    texts; null hosts and paths are sites of their own, hosts and paths of any type are compared as
    strings; without labels of both classes the evidence is nil; repeated rows stay and count each;
    other columns are ignored; an empty table gives none.
    """
    scored, sites, _ = site_scores(spark, docs, labels, **columns)
    out = sites.beside(scored, F.col("host"), F.col("path")).withColumn("prior", sites.prior(F.col("evidence")))
    out = out.withColumn("posterior", combine(F.col("evidence"), F.col("prior")))
    return out.select("key", "host", "path", "evidence", "prior", "posterior", (F.col("posterior") >= 0.5).alias("keep"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, unchanged; its cases hold here as well.

    Texts are scored again where they lie instead of being shuffled to their scores.  Columns of any
    name stay, but for names that begin with two underscores.
    """
    _, sites, model = site_scores(spark, docs, labels, key, text, host, path)
    fresh = with_evidence(docs, model, text, False, "__evidence")
    joined = sites.beside(fresh, F.col(host).cast("string"), F.col(path).cast("string"))
    return joined.where(combine(F.col("__evidence"), sites.prior(F.col("__evidence"))) >= 0.5).select(docs.columns)
