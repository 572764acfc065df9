"""Token counts against the libraries, and what the digest cache saves."""

import random
import uuid

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import counts
from tidewatch.llm.scratch import shared_dir

SCHEMA = "doc_id long, text string, digest long, n_tokens string, key int"
SPECIAL = [None, "", " ", "\n\t ", "a <|endoftext|> b<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> <| x", "Á J̌ Å Σας", "don't 12 345's !?", "日本語 😀x", "x" * 3000, "word " * 9000, "tab\tand  two\x0bspaces\x1cfs nb"]


def texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = ["the", "Ab", "ünï", "42", "'s", "<|", "|>", "…", "́", "é", "\x00", "한국", ".", "?!"]
    return SPECIAL + ["".join(rng.choice(alphabet) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def table(spark, ts):
    return spark.createDataFrame([(None if i % 9 == 8 else i, t, 1, "x", 2) for i, t in enumerate(ts)], SCHEMA).repartition(3)


def of_library(path, ts):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in ts]
    tool = Tokenizer.from_file(path)
    return [len(tool.encode(t or "", add_special_tokens=False)) for t in ts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    path, ts = public_tokenizers.path(name), texts(300) + SPECIAL
    got = sorted((r["key"] is not None, r["key"] or 0, r["n_bytes"], r["n_tokens"]) for r in counts.count_tokens(spark, table(spark, ts), path).collect())
    want = sorted((i % 9 != 8, 0 if i % 9 == 8 else i, len((t or "").encode()), n) for i, (t, n) in enumerate(zip(ts, of_library(path, ts), strict=True)))
    assert got == want


def test_only_distinct_misses_are_encoded(spark, monkeypatch):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    seen = []
    plain = counts.encoded
    monkeypatch.setattr(counts, "encoded", lambda df, p: seen.append(df.count()) or plain(df, p))
    ts = texts(50)
    first = {r["key"]: r["n_tokens"] for r in counts.count_tokens(spark, table(spark, ts * 3), path, cache).collect()}
    spaced = {t if t is None else " ".join(t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ")) for t in ts}
    assert seen[0] <= len(spaced) + 2 < len(ts * 3)  # copies, and texts that differ in runs of white space only, are one
    assert counts.count_tokens(spark, table(spark, ts), path, cache).count() == len(ts) and len(seen) == 1  # all hits
    monkeypatch.setattr(counts, "FEW_MISSES", 0)
    more = {r["key"]: r["n_tokens"] for r in counts.count_tokens(spark, table(spark, [*ts, "quite new", "quite  new", "newer"]), path, cache).collect()}
    assert seen[1:] == [2] and more[len(ts) + 1] == of_library(path, ["quite new"])[0]
    assert all(more[k] == first[k] for k in range(len(ts)) if k % 9 != 8)
    other = public_tokenizers.path("piece_bpe_32k.model")
    counts.count_tokens(spark, table(spark, ts), other, cache).count()
    assert seen[2] > 0  # another tokenizer's counts are not used
    held = spark.read.schema(counts.CACHE).parquet(cache).groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("d")).collect()
    assert len(held) == 2 and all(r["n"] == r["d"] for r in held)


def test_empty_table(spark):
    assert counts.count_tokens(spark, spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).count() == 0
