"""Substring de-duplication by level-wise doubling of repeated word windows (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.llm import words as W
from lynxframe.llm.common import NO_ID, Scratch, digest, hot_keys, lean, salted_join, text_or_empty

SEEDS = "text_key long, seed long"
WINDOWS = "oid long, text_key long, h1 long, h2 long, at array<int>"
RESULT = "dig binary, whole boolean, n_words long, n_removed long, kept_sha256 string, kept_text string"


def levels(window: int, shortest: int = 8) -> list[int]:
    """The lengths from short windows up to the full one, each at most twice the one before: 13 gives 7, 13."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _alive(words: np.ndarray, window: int, length: int, marked: np.ndarray | None) -> np.ndarray:
    """Places of the full windows that can still repeat, given the repeated windows of ``length`` (None: all can)."""
    n = len(words) - window + 1
    if n <= 0 or marked is None:
        return np.arange(max(n, 0))
    return np.flatnonzero(np.isin(_least(words, window, length), marked))


def _least(words: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each full window the least of its windows of ``length``.

    Equal full windows have the same one, so a full window can repeat only if its least short window does, and only
    these need be counted.
    """
    short = W.windows(words, length)
    views = np.lib.stride_tricks.sliding_window_view(short, window - length + 1)
    return short[views.argmin(axis=1) + np.arange(len(views))]


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """Remove each word that lies in a run of ``window`` words which also starts in a document with a smaller doc_id.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged; windows are judged on the input. Level-wise: first the windows
    of the shortest of ``levels`` are counted (each full window is stood for by its least short one); only where a short
    window occurs in two different texts is it extended to twice the length and counted again, until the full length is
    reached or no candidate is left. Equal texts are one text with its smallest doc_id: in every other copy all
    windows start in a smaller document too. Full windows are compared by 128 bits.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) and, if
    asked, kept_text. Null and empty texts have no words; rows that repeat a doc_id do not remove each other's words; a
    null doc_id counts as larger than all others and equal to other nulls; an empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    base = base.withColumn("oid", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("dig", digest(F.col("text")))

    lengths = levels(window)

    def seeds(length: int, before: int | None):
        """The least windows of ``length`` of the full windows that are left, each once a text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, bounds = W.split(batch.column("text"))
                all_words = W.hashes(flat)
                keys, found = batch.column("text_key").to_numpy(), []
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if b - a >= window:
                        marked = batch.column("seeds")[k].values.to_numpy().view(np.uint64) if before else None
                        at = _alive(all_words[a:b], window, before, marked)
                        if len(at):
                            found.append((keys[k], np.unique(_least(all_words[a:b], window, length)[at])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _ in found], [len(x) for _, x in found]), pa.int64()), _signed(np.concatenate([x for _, x in found]))], ["text_key", "seed"])

        return run

    # One text a digest, with the smallest id of its copies.
    texts = scratch.save(base.groupBy("dig").agg(F.min("oid").alias("oid"), F.first("text").alias("text"))).withColumn("text_key", F.xxhash64("dig"))

    marks, before = None, None
    for length in lengths[:-1]:
        # Windows of this length that occur in two different texts; a text has each of its seeds once.
        asked = texts.select("text_key", "text") if marks is None else texts.join(marks.hint("merge"), "text_key").select("text_key", "text", "seeds")
        found = scratch.save(asked.mapInArrow(lean(seeds(length, before)), SEEDS))
        repeated = scratch.save(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"))
        if marks is not None:
            scratch.drop(marks)
        marks = scratch.save(salted_join(found, repeated.select("seed"), ["seed"], hot_keys(repeated), ["text_key"]).groupBy("text_key").agg(F.collect_list("seed").alias("seeds")))
        scratch.drop(found, repeated)
        before = length
        if marks.isEmpty():
            break

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = W.split(batch.column("text"))
            all_words = W.hashes(flat)
            second = W.hashes(flat, 1)
            oids, keys = batch.column("oid").to_pylist(), batch.column("text_key").to_pylist()
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                marked = batch.column("seeds")[k].values.to_numpy().view(np.uint64) if before else None
                at = _alive(all_words[a:b], window, before, marked)
                if len(at):
                    one, two = W.windows(all_words[a:b], window)[at], W.windows(second[a:b], window, W.BASES[1])[at]
                    # A window that the text has several times is one row.
                    order = np.lexsort((at, two, one))
                    at, one, two = at[order].astype(np.int32), one[order], two[order]
                    new = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
                    places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(at))
                    n = len(new)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, oids[k]), pa.int64()), pa.array(np.full(n, keys[k]), pa.int64()), _signed(one[new]), _signed(two[new]), places], ["oid", "text_key", "h1", "h2", "at"])

    # The full windows that are left, each with the smallest document that it starts in.
    left = texts.select("oid", "text_key", "text") if marks is None else texts.join(marks.hint("merge"), "text_key").select("oid", "text_key", "text", "seeds")
    long = scratch.save(left.mapInArrow(lean(extended), WINDOWS))
    if marks is not None:
        scratch.drop(marks)
    first = long.groupBy("h1", "h2").agg(F.min("oid").alias("first_oid"), F.max("oid").alias("last_oid"), F.count("*").alias("n")).where("first_oid < last_oid")
    first = scratch.save(first.select("h1", "h2", "first_oid", "n"))
    hits = salted_join(long, first.select("h1", "h2", "first_oid"), ["h1", "h2"], hot_keys(first), ["oid", "text_key"]).where("oid > first_oid").select("oid", "text_key", "at")
    hits = scratch.save(hits.groupBy("oid", "text_key").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("hits")))
    scratch.drop(long, first)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for dig, text, at in zip(batch.column("dig").to_pylist(), batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                found = text.encode().split()
                gone = np.zeros(len(found) + 1, np.int32)
                if at:
                    gone[at] += 1
                    np.subtract.at(gone, np.array(at) + window, 1)
                stay = np.cumsum(gone)[:-1] == 0
                rest = b" ".join([w for w, s in zip(found, stay.tolist(), strict=True) if s])
                rows.append((dig, False, len(found), int(len(found) - stay.sum()), hashlib.sha256(rest).hexdigest(), rest.decode() if with_text else None))
                if len(found) >= window:  # the same text in a document that is not its first
                    rows.append((dig, True, len(found), len(found), hashlib.sha256(b"").hexdigest(), "" if with_text else None))
                else:
                    rows.append((dig, True, *rows[-1][2:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["dig", "whole", "n_words", "n_removed", "kept_sha256", "kept_text"])

    judged = texts.join(hits.hint("merge"), ["oid", "text_key"], "left").select("dig", "text", "hits").mapInArrow(lean(kept), RESULT)
    firsts = texts.select("dig", F.col("oid").alias("first_oid"))
    rows = base.select("doc_id", "oid", "dig").join(firsts.hint("merge"), "dig").select("doc_id", "dig", (F.col("oid") > F.col("first_oid")).alias("whole"))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return rows.join(scratch.save(judged).hint("merge"), ["dig", "whole"]).select(*columns)
