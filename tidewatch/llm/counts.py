"""Token counts through a digest cache: a text that was counted once, anywhere, is never encoded again."""

import hashlib
import importlib.metadata
import json
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.blocks import handfuls
from tidewatch.llm.packing import tokens_of
from tidewatch.llm.scratch import cut, shared_dir
from tidewatch.llm.spread import join_spread

#: So many missing digests are broadcast at most (32 bytes each); more are found by a shuffle.
FEW_MISSES = 1 << 17
CACHE = "digest binary, n_tokens bigint, version string"


def library_of(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, its library and the library's version: counts of another version are never used."""
    library = library_of(path)
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + f.read()).hexdigest()


def spaces_collapse(path: str) -> bool:
    """Whether the tokenizer itself makes one space of every run of white space before it does anything else that counts."""
    if library_of(path) != "tokenizers":
        return False
    with open(path, encoding="utf-8") as f:
        steps = json.load(f).get("normalizer") or {}
    return any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps.get("normalizers", [steps]))


def normalised(text: Column, path: str) -> Column:
    """The content that a digest stands for: null is empty, and runs of white space are one space where the tokenizer has it so."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, "[ \t\n\u000b\f\r]+", " ") if spaces_collapse(path) else text


@lru_cache(4)
def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Counts of a column of texts: no begin, end or added special tokens, no truncation, no padding."""
    if library_of(path) == "sentencepiece":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda column: np.array([len(x) for x in model.encode(column.to_pylist(), num_threads=1)], np.int64)
    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    if spec["model"].get("end_of_word_suffix") == "</w>":
        words = tokens_of(path)
        if first.get("pattern") == {"Regex": words.split.pattern} and first.get("behavior") == "Removed":
            return lambda column: words(column, 0)[1] - 1  # the end id that each text has there
    return lambda column: np.array([len(e) for e in tool.encode_batch_fast(column.to_pylist(), add_special_tokens=False)], np.int64)


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """``(digest, n_tokens)`` of ``texts(digest, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for b in handfuls(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1)))], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` that a cache holds for a version, one row a digest; none where there is no cache yet."""
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("version").parquet(cache)  # so that an empty cache can be read
    return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, cache: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_tokens)`` of every row.

    ``cache`` is a Parquet folder, ``digest, n_tokens`` by ``version``, that is made if missing and
    grows with every run; without it a run has a cache of its own in the shared folder.  Digests of
    all rows meet the cache; of those it lacks one text each is encoded and the counts are
    appended, and every row then takes its digest's count.  Two runs that append one digest agree
    on its count, and a run that died before its append has lost nothing but its work.

    Null and empty texts have no tokens; texts of any length are read whole; repeated rows and null
    keys are rows like others; other columns are ignored; an empty table gives none.
    """
    version, cache = tokenizer_version(path), cache or f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    content = normalised(F.col(text), path)
    digest = F.unhex(F.sha2(content, 256))
    told, _ = cut(spark, docs.select(F.col(key).alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), digest.alias("digest")))
    missing, _ = cut(spark, told.select("digest").distinct().join(read_cache(spark, cache, version), "digest", "left_anti"))
    n = missing.count()
    if n:
        texts = docs.select(digest.alias("digest"), content.alias("text"))
        if n <= FEW_MISSES:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
            distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
        else:  # copies meet before anything is shuffled; both sides then lie by digest
            distinct = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
        encoded(distinct, path).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    known = read_cache(spark, cache, version).join(told.select("digest").distinct(), "digest", "left_semi")
    return join_spread(spark, told, known, ["digest"]).select("key", "n_bytes", "n_tokens")
