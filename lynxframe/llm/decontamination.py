"""Benchmark decontamination by SimHash of item-sized windows (operator 7)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.llm import words as W
from lynxframe.llm.common import lean

MATCHES = "doc_id long, item_id long, start long, n_words long, similarity double, hamming int"
NOTHING = np.uint64(xxhash.xxh64_intdigest(""))
POPCOUNT = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def plain(word: str) -> str:
    """A word without case and punctuation."""
    return "".join(c for c in word.lower() if c.isalnum())


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts' plain words, and each text's bounds. Words of punctuation only are no words."""
    flat, bounds = W.split(texts)
    found = W.hashes(flat, make=plain)
    stay = found != NOTHING
    return found[stay], np.concatenate(([0], np.cumsum(stay)))[bounds]


def bits(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones per shingle."""
    return np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def to_prints(ones: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints from the counts of ones among ``n`` shingles."""
    return np.packbits(2 * ones > n, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return POPCOUNT[np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)].sum(axis=1, dtype=np.int64)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: a shingle weighs as often as it occurs."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class HammingIndex:
    """Fingerprints by blocks: two within ``radius`` agree up to radius // blocks bits in some block, so each is listed
    under all block values so near to its own."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int):
        self.prints, self.radius = prints, radius
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.parts = []
        for low, high in zip(edges, edges[1:], strict=False):
            near = np.array([sum(1 << b for b in c) for r in range(radius // blocks + 1) for c in combinations(range(high - low), r)], np.int64)
            own = self.value(prints, low, high)
            keys = (own[:, None] ^ near).ravel()
            order = np.argsort(keys, kind="stable")
            offsets = np.searchsorted(keys[order], np.arange((1 << (high - low)) + 1))
            self.parts.append((low, high, offsets, np.repeat(np.arange(len(prints)), len(near))[order]))

    @staticmethod
    def value(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (place in ``prints``, place in the index, distance) within the radius, each once."""
        found = []
        for low, high, offsets, entries in self.parts:
            v = self.value(prints, low, high)
            n = offsets[v + 1] - offsets[v]
            at = np.repeat(np.arange(len(prints)), n)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            found.append(at * len(self.prints) + entries[offsets[v][at] + inner])
        pairs = np.unique(np.concatenate(found))
        at, of = pairs // len(self.prints), pairs % len(self.prints)
        far = hamming(prints[at], self.prints[of])
        near = far <= self.radius
        return at[near], of[near], far[near]


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int, radius: int, blocks: int):
        ids, texts = [i for i, _ in rows], pa.array([t for _, t in rows], pa.string())
        found, bounds = plain_words(texts)
        by_size: dict[int, list[int]] = defaultdict(list)
        self.ids, self.counts = ids, [Counter()] * len(ids)
        prints = np.zeros(len(ids), np.uint64)
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k in range(len(ids)):
            own = found[bounds[k] : bounds[k + 1]]
            if n := len(own):
                width = min(shingle, n)
                sh = W.windows(own, width)
                prints[k] = to_prints(bits(sh).sum(axis=0, dtype=np.int64), len(sh))
                self.counts[k] = Counter(sh.tolist())
                by_size[n].append(k)
                for x in set(sh.tolist()):
                    seeds[width][x].add(n)
        self.groups = {n: (np.array(k), HammingIndex(prints[k], radius, blocks)) for n, k in by_size.items()}
        self.longest = max(by_size, default=0)
        self.seeds = {w: (np.array(sorted(s), np.uint64), s) for w, s in seeds.items()}
        self.tables = {}
        for w, (values, _) in self.seeds.items():
            mask = np.uint64((1 << max(16, (len(values) * 8).bit_length())) - 1)
            table = np.zeros(int(mask) + 1, bool)
            table[values & mask] = True
            self.tables[w] = (mask, table)

    def hits(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """Places of shingles that some item has."""
        mask, table = self.tables[width]
        values = self.seeds[width][0]
        at = np.flatnonzero(table[shingles & mask])
        return at[values[np.minimum(np.searchsorted(values, shingles[at]), len(values) - 1)] == shingles[at]]

    def matches(self, shingles: np.ndarray, hits: np.ndarray, n_words: int, width: int, least: float) -> dict[int, tuple]:
        """Of one document: item -> (similarity, start, hamming) of its best window. ``hits``: places in ``shingles``."""
        best: dict[int, tuple] = {}
        sizes = self.seeds[width][1]
        starts: dict[int, list[int]] = defaultdict(list)
        for p in hits.tolist():
            for n in sizes[int(shingles[p])]:
                starts[n].append(p)
        for n, seen in starts.items():
            if n > n_words:
                # Too short for a window: the whole document is one, if it can have enough of the item's shingles.
                if len(shingles) >= least * (n - width + 1):
                    members, index = self.groups[n]
                    prints = to_prints(bits(shingles).sum(axis=0, dtype=np.int64), len(shingles))
                    for _, k, far in zip(*[x.tolist() for x in index.search(prints[None])], strict=True):
                        item = int(members[k])
                        sim = similarity(Counter(shingles.tolist()), self.counts[item])
                        if sim >= least:
                            best[item] = (sim, 0, far)
                continue
            reach = n - width  # a window may begin so far before a shingle that it holds
            marks = np.zeros(n_words - n + 2, np.int32)
            seen = np.array(seen)
            np.add.at(marks, np.clip(seen - reach, 0, n_words - n + 1), 1)
            np.add.at(marks, np.clip(seen + 1, 0, n_words - n + 1), -1)
            at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            for cut in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                for part in np.array_split(cut, -(-len(cut) // 8192)) if len(cut) else []:
                    low = part[0]
                    ones = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits(shingles[low : part[-1] + reach + 1]), axis=0, dtype=np.int32)))
                    prints = to_prints(ones[part - low + reach + 1] - ones[part - low], reach + 1)
                    members, index = self.groups[n]
                    for w, k, far in zip(*[x.tolist() for x in index.search(prints)], strict=True):
                        item, start = int(members[k]), int(part[w])
                        sim = similarity(Counter(shingles[start : start + reach + 1].tolist()), self.counts[item])
                        if sim >= least and (item not in best or (sim, -start) > (best[item][0], -best[item][1])):
                            best[item] = (sim, start, far)
        return best


def item_blocks(benchmark: DataFrame, items: int, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most ``items`` rows and about ``chars`` characters, never whole on the driver."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= items or size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, shingle: int = 5, radius: int = 23, blocks: int = 6, block_items: int = 5000, block_chars: int = 8_000_000) -> DataFrame:
    """Windows of documents that are like a benchmark item of as many words.

    Words are compared without case and punctuation. Every window of an item's number of words that shares at least one
    ``shingle``-word shingle with an item of that size (any other has similarity 0) gets a SimHash; a Hamming index of
    ``blocks`` blocks finds all item fingerprints within ``radius``; the exact similarity, weighted Jaccard of the
    shingles with their counts, verifies each. A document of fewer words than an item is one window. Shorter items have one shingle, the whole item. The radius is about 4.5
    standard deviations above the mean distance at similarity 0.8. The benchmark goes to the executors in blocks of at
    most ``block_items`` items and about ``block_chars`` characters, each block against all documents.

    Returns a row per document and item found: doc_id, item_id, start (plain word), n_words (of the item), similarity, hamming, for the
    item's best window there. Null and empty texts on either side match nothing; repeated rows, and a null doc_id, are
    rows like any other; null item ids are left out; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, shingle, radius, blocks)
            for batch in batches:
                found, bounds = plain_words(batch.column("text"))
                ids, out = batch.column("doc_id").to_pylist(), []
                for width in items.seeds:
                    all_shingles = W.windows(found, width)
                    hits = items.hits(all_shingles, width)
                    doc = np.searchsorted(bounds, hits, side="right") - 1
                    inside = hits + width <= bounds[doc + 1]
                    hits, doc = hits[inside], doc[inside]
                    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
                        if len(part):
                            d = doc[part[0]]
                            n = int(bounds[d + 1] - bounds[d])
                            shingles = all_shingles[bounds[d] : bounds[d + 1] - width + 1]
                            for item, (sim, start, far) in items.matches(shingles, hits[part] - bounds[d], n, width, least).items():
                                out.append((ids[d], items.ids[item], start, sum(items.counts[item].values()) + width - 1, sim, far))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.float64(), pa.int32()], strict=True)], ["doc_id", "item_id", "start", "n_words", "similarity", "hamming"])

        return run

    found = spark.createDataFrame([], MATCHES)
    for block in item_blocks(benchmark, block_items, block_chars):
        found = found.unionByName(rows.mapInArrow(lean(scan(spark.sparkContext.broadcast(block))), MATCHES))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns.

    Rows with a null doc_id are matched by their text alone. Options and the treatment of nulls: ``find_contamination``.
    """
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text")))
    bad = find_contamination(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad.hint("merge"), key, "left_anti").select(*docs.columns)
