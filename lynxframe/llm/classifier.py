"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.llm import words as W
from lynxframe.llm.common import lean

#: What is known of a document: nothing but its text. Shares are of all bytes, words or lines.
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digits", "marks", "symbols", "blanks", "controls", "beyond_ascii", "byte_entropy",
    "word_bytes", "word_bytes_spread", "longest_word", "distinct_words", "commonest_word", "repeated_pairs", "repeated_triples", "upper_words", "odd_ends",
    "line_words", "repeated_lines", "blank_lines",
)

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "marks": [ord(c) for c in ".,;:!?'\"()-"], "symbols": [ord(c) for c in "#*$%&|<>@^~_=+/\\{}[]`"],
    "blanks": [32], "controls": [*range(32), 127], "beyond_ascii": range(128, 256),
}
RESULT = "doc_id long, score double"


def _per_text(owner: np.ndarray, code: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of things (numbers below ``width``) that texts have: how many distinct ones, how often the commonest is there, and
    how many occurrences are of things that the text has twice or more."""
    pairs, count = np.unique(owner * max(width, 1) + code, return_counts=True)
    of = pairs // max(width, 1)
    most = np.zeros(n)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=n), most, np.bincount(of, weights=np.where(count > 1, count, 0), minlength=n)


def _runs_repeated(owner: np.ndarray, numbers: np.ndarray, length: int, n: int) -> np.ndarray:
    """Of the runs of ``length`` words of each text: the share that the text has twice or more."""
    own = np.zeros(len(owner), bool)
    own[: max(len(owner) - length + 1, 0)] = owner[: len(owner) - length + 1] == owner[length - 1 :] if len(owner) >= length else False
    at = np.flatnonzero(own)
    _, code = np.unique(W.windows(numbers, length)[at], return_inverse=True)
    _, _, again = _per_text(owner[at], code, n, len(at))
    return again / np.maximum(np.bincount(owner[at], minlength=n), 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text, from the whole text; null texts are empty, and all statistics of an empty one 0."""
    n = len(texts)
    t = pc.fill_null(texts, "").cast(pa.large_string())
    if not n:
        return np.zeros((0, len(STATISTICS)))
    bounds = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + n + 1]
    raw = np.frombuffer(t.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if t.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(bounds)
    histogram = np.zeros((n, 256))
    for k in range(n):  # a text's bytes at a time, so that the indexes stay small
        histogram[k] = np.bincount(raw[bounds[k] - bounds[0] : bounds[k + 1] - bounds[0]], minlength=256)
    share = histogram / np.maximum(size, 1)[:, None]
    out = {name: share[:, list(codes)].sum(axis=1) for name, codes in _CLASSES.items()}
    out["byte_entropy"] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    flat, cuts = W.split(t)
    words = np.diff(cuts)
    owner = np.repeat(np.arange(n), words)
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    spelt, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    some = np.maximum(words, 1)
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(float)
    mean = np.bincount(owner, weights=lengths, minlength=n) / some
    longest = np.zeros(n)
    np.maximum.at(longest, owner, lengths)
    distinct, most, _ = _per_text(owner, code, n, len(spelt))
    upper = np.fromiter((x.isupper() for x in spelt), bool, len(spelt))
    odd = np.fromiter((not x[-1].isalnum() and x[-1] not in ".,;:!?'\")-" for x in spelt), bool, len(spelt))
    numbers = code.astype(np.uint64) * W.BASES[0]
    out |= {
        "word_bytes": mean,
        "word_bytes_spread": np.sqrt(np.maximum(np.bincount(owner, weights=lengths**2, minlength=n) / some - mean**2, 0)),
        "longest_word": np.log1p(longest),
        "distinct_words": distinct / some,
        "commonest_word": most / some,
        "repeated_pairs": _runs_repeated(owner, numbers, 2, n),
        "repeated_triples": _runs_repeated(owner, numbers, 3, n),
        "upper_words": np.bincount(owner, weights=upper[code], minlength=n) / some,
        "odd_ends": np.bincount(owner, weights=odd[code], minlength=n) / some,
    }

    split = pc.split_pattern(t, "\n")
    line, per_text = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(n), per_text)
    filled = pc.binary_length(pc.utf8_trim_whitespace(line)).to_numpy(zero_copy_only=False) > 0
    coded = line.filter(pa.array(filled)).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    lines = np.bincount(of[filled], minlength=n)
    kinds, _, _ = _per_text(of[filled], coded.indices.to_numpy(zero_copy_only=False), n, len(coded.dictionary))
    out |= {"log_bytes": np.log1p(size), "log_words": np.log1p(words), "log_lines": np.log1p(lines), "line_words": np.log1p(words / np.maximum(lines, 1)), "repeated_lines": 1 - kinds / np.maximum(lines, 1), "blank_lines": np.bincount(of[~filled], minlength=n) / np.maximum(per_text, 1)}
    return np.where((size > 0)[:, None], np.column_stack([out[x] for x in STATISTICS]), 0.0)


@dataclass(frozen=True)
class Trees:
    """Trees of one depth as arrays: inner nodes in heap order (``feature``, ``limit``: right if greater) and leaves."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The chance of label 1: all rows go down all trees a level at a time."""
        n_trees, inner = self.feature.shape
        node = np.zeros((len(rows), n_trees), np.int64)
        tree = np.arange(n_trees)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (np.take_along_axis(rows, self.feature[tree, node], axis=1) > self.limit[tree, node])
        total = self.base + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 5.0, least: float = 1.0) -> Trees:
    """Boosted trees for the log loss. Statistics are binned once by their quantiles; each level of a tree is found from
    the histograms of gradients and curvatures of its nodes. A node whose best split gains nothing, or whose sides have
    less than ``least`` of curvature, sends all its rows left. Without two different labels the trees say the mean (0.5
    of no rows)."""
    n, width = rows.shape
    inner = (1 << depth) - 1
    mean = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    feature, limit, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1))
    if not n or labels.min() == labels.max():
        return Trees(feature, limit, leaf, base)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)])
    spread = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        spread[f, : len(e)] = e
    total = np.full(n, base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = labels - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * width + np.arange(width)) * bins + binned
            g, h = [np.bincount(key.ravel(), weights=np.repeat(x, width), minlength=k * width * bins).reshape(k, width, bins).cumsum(axis=2) for x in (slope, curve)]
            of_all = g[:, :, -1:] ** 2 / (h[:, :, -1:] + ridge)
            right_g, right_h = g[:, :, -1:] - g, h[:, :, -1:] - h
            gain = g**2 / (h + ridge) + right_g**2 / (right_h + ridge) - of_all
            gain[(h < least) | (right_h < least) | ~np.isfinite(spread)[None]] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            useful = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            feature[t, first : first + k] = best // bins
            limit[t, first : first + k] = np.where(useful, spread[best // bins, best % bins], np.inf)
            at = node
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, at]] > limit[t, at])
        g, h = [np.bincount(node - inner, weights=x, minlength=inner + 1) for x in (slope, curve)]
        leaf[t] = rate * g / (h + ridge)
        total = total + leaf[t, node - inner]
    return Trees(feature, limit, leaf, base)


def _remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **settings) -> Trees:
    """Trees for ``labels.quality`` fitted on at most ``most_rows`` labelled documents that are not held out (those with the
    smallest hash of their doc_id). Only their statistics, some 200 bytes a row, come to the driver. Null labels, ids with
    different labels and labels of no document are left out; of texts that share an id each is a row."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (_remainder() != 0))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    sample = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(batch.column("text"))
            cuts = pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.ListArray.from_arrays(cuts, pa.array(rows.ravel()))], ["doc_id", "quality", "row"])

    got = chosen.mapInArrow(lean(measured, 500), "doc_id long, quality int, row array<double>").orderBy("doc_id", "row").limit(most_rows).toArrow()
    rows = got["row"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(rows, got["quality"].to_numpy().astype(float) if got.num_rows else np.zeros(0), **settings)


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """Every document with its chance of label 1, by its whole text: doc_id, held_out, score, predicted."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(statistics(batch.column("text"))), pa.float64())], ["doc_id", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(lean(scored, 500), RESULT)
    return out.select("doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """Quality of every row of ``docs`` (doc_id, text) as ``labels`` (doc_id, quality 0 or 1) mark it.

    Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0, from at most ``most_rows`` of them; a score
    comes from statistics of the whole text alone. Returns doc_id, held_out (that remainder is 0), score (0 to 1) and
    predicted (1 if the score reaches ``threshold``).

    Null and empty texts have all statistics 0 and a score as any other; a null doc_id is not held out and has no label;
    repeated rows have equal scores; without labels of both kinds every score is the mean label, 0.5 if there is none; an
    empty table gives no rows; other columns are not read.
    """
    return score(docs, train(docs, labels, most_rows), threshold)
