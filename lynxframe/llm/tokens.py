"""Tokenizers by file, and token counts behind a digest cache (operator 2)."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.llm.common import Scratch, digest, hot_join, hot_keys, lean, text_or_empty

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine; a name that is a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file is another cache entry."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.lru_cache(4)
def load_counter(path: str):
    """A function from texts to their token counts, by the library that the file's kind names."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        return lambda texts: [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        encoding = load_ranks(path)
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]
    raise ValueError(f"no library for {path}")


@functools.lru_cache(4)
def load_ranks(path: str, special: tuple[tuple[str, int], ...] = ()):
    """A byte-level BPE from a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def _slices(texts: list[str], limit: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters, so that a batch's encodings stay small."""
    run, size = [], 0
    for x in texts:
        run.append(x)
        size += len(x)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def count_texts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``content``, ``text`` -> ``content``, ``tokenizer``, ``n_tokens``: every row is encoded whole."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        count, version = load_counter(path), tokenizer_version(path)
        for batch in batches:
            n = [k for run in _slices(batch.column("text").to_pylist()) for k in count(run)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                ["content", "tokenizer", "n_tokens"],
            )

    return texts.select("content", "text").mapInArrow(lean(encode), CACHE_SCHEMA)


def read_cache(spark: SparkSession, cache: str | None) -> DataFrame:
    """The stored counts; one row a key even if a lost writer stored some twice. A missing or empty cache has no rows."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    if cache is None:
        return empty
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return empty
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return stored.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """Token count of every whole text, through a cache of counts in the folder ``cache``.

    A text's key is the SHA-256 of its content (null is taken as the empty text, nothing else is normalised, as any
    other change could change the count) with the SHA-256 of the tokenizer's file. Keys that the cache has are looked
    up; of the others each distinct text is encoded once and its count is appended. Without ``cache`` a new one is begun
    in the shared folder.

    Returns one row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Null and empty texts count
    0 tokens; repeated rows and copies all get their row; a null doc_id stays null; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    cache = cache or f"{scratch.root}/cache"
    version = tokenizer_version(tokenizer_path(tokenizer))
    texts = docs.select(F.col("doc_id"), text_or_empty().alias("text")).withColumn("content", digest(F.col("text")))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    # One text a digest, combined before the shuffle and before the cache is asked: copies do not travel, whatever it holds.
    misses = texts.groupBy("content").agg(F.first("text").alias("text")).join(known, "content", "left_anti")
    count_texts(misses, tokenizer).write.mode("append").option("compression", "zstd").parquet(cache)
    scratch.release()
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    # A text may have very many copies: rows of frequent digests get their few counts by broadcast.
    rows = scratch.save(texts.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")))
    hot = hot_keys(rows.groupBy("content").agg(F.count("*").alias("n")))
    return hot_join(rows, scratch.save(counts), ["content"], hot).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
