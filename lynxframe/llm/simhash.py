"""SimHash near-duplicates by anchor-point covering (operator 9)."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.llm import words as W
from lynxframe.llm.common import NO_ID, Scratch, digest, hot_join, hot_keys, lean, salted_join, text_or_empty
from lynxframe.operators.graph import connected

#: Fixed values of the perfect binary Golay code: word length, check bits, covering radius, generator polynomial.
BITS, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b101011100011

#: Longs of a sketch.
SKETCH = 16

#: ASCII capitals only, as bytes of UTF-8.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: a bit is 1 if more than half of the shingles' hashes have it."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = ends - lengths, ends[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    values = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[: len(ends)].tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(values), 1 << 15):
        run = values[k : k + (1 << 15)]
        ones += np.unpackbits(run.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders of the 23-bit words by the generator polynomial: 0 for anchors."""
    x = x.copy()
    for k in range(BITS - 1, CHECKS - 1, -1):
        x ^= np.where(x >> k & 1, GENERATOR << (k - CHECKS), 0)
    return x


@functools.cache
def covering(more: int) -> list[list[np.ndarray]]:
    """For each remainder the words that have it, by how far their weight goes beyond RADIUS: x's anchors are x ^ word."""
    found: list[list[list[int]]] = [[[] for _ in range(more + 1)] for _ in range(1 << CHECKS)]
    for weight in range(RADIUS + more + 1):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(BITS), weight)], np.int64)
        for e, s in zip(errors.tolist(), syndromes(errors).tolist(), strict=True):
            found[s][max(0, weight - RADIUS)].append(e)
    return [[np.array(x, np.int64) for x in by] for by in found]


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits 0 to 22 and bits 23 to 45."""
    mask = np.uint64((1 << BITS) - 1)
    return (values & mask).astype(np.int64), (values >> np.uint64(BITS) & mask).astype(np.int64)


def own_anchor(values: np.ndarray) -> np.ndarray:
    """The one anchor within RADIUS in either half: the code is perfect, so each word has exactly one code word so near."""
    leaders = np.array([by[0][0] for by in covering(0)], np.int64)
    one, two = halves(values)
    return (one ^ leaders[syndromes(one)]) | (two ^ leaders[syndromes(two)]) << BITS


@functools.cache
def reachable(distance: int) -> tuple[np.ndarray, np.ndarray]:
    """``covering`` as two arrays, a line a remainder: the words, and how far each lies beyond RADIUS (filled up with 127)."""
    lists = covering(distance)
    wide = max(sum(map(len, by)) for by in lists)
    words, beyond = np.zeros((len(lists), wide), np.int64), np.full((len(lists), wide), 127, np.int8)
    for line, far, by in zip(words, beyond, lists, strict=True):
        own = np.concatenate(by)
        line[: len(own)], far[: len(own)] = own, np.repeat(np.arange(distance + 1), [len(x) for x in by])
    return words, beyond


def near_anchors(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the value, anchor) for all anchors beyond RADIUS by ``distance`` over both halves at most.

    These are the own anchors of whatever differs from the value in ``distance`` bits or fewer, and some more.
    """
    one, two = halves(values)
    s, t = syndromes(one), syndromes(two)
    words, beyond = reachable(distance)
    ats, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(values), 256):
        u, v = s[k : k + 256], t[k : k + 256]
        at, i, j = np.nonzero(beyond[u][:, :, None].astype(np.int16) + beyond[v][:, None, :] <= distance)
        ats.append(at + k)
        anchors.append((words[u[at], i] | words[v[at], j] << BITS) ^ (one | two << BITS)[at + k])
    return np.concatenate(ats), np.concatenate(anchors)


def anchor_places(anchors: np.ndarray) -> np.ndarray:
    """Numbers of anchors below 2 ** 24, each its own: the upper 12 bits of a code word give the others."""
    return (anchors >> CHECKS & (1 << BITS - CHECKS) - 1) | (anchors >> BITS + CHECKS & (1 << BITS - CHECKS) - 1) << BITS - CHECKS


def held_anchors(held: DataFrame, first: int, n: int) -> bytes:
    """``anchor`` (with the number of its view) -> a bitmap of the places of its anchors, for each of ``n`` views in turn.

    Spark makes it in pieces of 4 KB; a view has 2 MB at most, however many rows there are. Compressed for its way to the tasks.
    """
    width = BITS - CHECKS
    free = (1 << width) - 1
    at = F.expr(f"((anchor >> {CHECKS}) & {free}) + (((anchor >> {BITS + CHECKS}) & {free}) << {width}) + (((anchor >> {2 * BITS}) - {first}) << {2 * width}) + 1")
    pieces = held.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    found = np.zeros((n << 2 * width - 15, 1 << 12), np.uint8)
    for piece, bits in pieces.collect():
        found[piece - 1] = np.frombuffer(bits, np.uint8)
    return zlib.compress(found.tobytes(), 1)


def unpacked(packed: bytes, n: int) -> np.ndarray:
    """The bitmaps of ``held_anchors``, a line for each of ``n`` views."""
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(n, -1)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle, seed) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(compute), "doc_id long, fp long")


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """``fp`` (distinct) -> ``a`` < ``b``: all pairs that differ in at most ``distance`` bits, each once.

    Every fingerprint goes to all anchors within the covering radius plus ``distance`` and is compared at each with the
    fingerprints whose own anchor it is. The comparison is part of the join, so only links leave it.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(own_anchor(values.view(np.uint64))), pa.array(values)], ["anchor", "a"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for k in range(0, len(values), 10_000):
                run = values[k : k + 10_000]
                at, anchor = near_anchors(run.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(run[at])], ["anchor", "b"])

    owners = distinct.select("fp").mapInArrow(lean(place), "anchor long, a long")
    others = distinct.select("fp").mapInArrow(lean(replicate), "anchor long, b long")
    near = F.expr(f"a < b and bit_count(a ^ b) <= {distance}")
    return owners.hint("merge").join(others, (owners.anchor == others.anchor) & near).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """Fingerprint and component of every document.

    Texts are lower-cased in A-Z, cut into words ``[^\\x20\\x09-\\x0D]+`` and ``shingle``-word shingles, repeats included
    (fewer words: the whole sequence). Fingerprints link at ``distance`` or fewer differing bits.

    Returns one row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id
    reachable, itself included). Null, empty and blank texts have fingerprint zero and link like any other; copies share
    a fingerprint, so only distinct fingerprints are compared; rows that repeat a doc_id are rows of their own; rows
    with a null doc_id get a component like others, null only if no row of it has an id; an empty table gives no rows;
    other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, shingle, seed).withColumn("oid", F.coalesce("doc_id", F.lit(NO_ID))))
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("oid").alias("oid")))
    found = scratch.save(links(distinct, distance))
    roots = connected(found, scratch)
    known = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "oid", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("oid").alias("component_id"))
    named = scratch.save(known.join(least.hint("merge"), "root").select("fp", "component_id"))
    return rows.join(named.hint("merge"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id")
    )


def lowered(word: str) -> bytes:
    return word.encode().translate(LOWER)


def bag_prints(words: np.ndarray, views: int) -> np.ndarray:
    """``views`` independent 64-bit SimHashes of a set of word numbers."""
    distinct, out = np.unique(words), np.zeros(views, np.uint64)
    with np.errstate(over="ignore"):
        for v in range(views if len(distinct) else 0):
            h = W.mixed(W.mixed(distinct + np.uint64(v + 1) * W.BASES[0]) * W.BASES[1])
            ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[v] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def shingles(words: np.ndarray, shingle: int) -> np.ndarray:
    """The distinct ``shingle``-word shingles of a text's words as numbers (fewer words: the whole sequence)."""
    return np.unique(W.windows(words, min(shingle, len(words)))) if len(words) else words[:0]


def sketch(numbers: np.ndarray) -> np.ndarray:
    """Which of ``64 * SKETCH`` bins hold a shingle of the set, as ``SKETCH`` longs."""
    bins = np.zeros(64 * SKETCH, np.uint8)
    with np.errstate(over="ignore"):
        bins[(W.mixed(numbers * W.BASES[1]) % np.uint64(64 * SKETCH)).astype(np.int64)] = 1
    return np.packbits(bins, bitorder="little").view(np.int64)


def possible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` of which ``sketches`` (id, n: the set's size, bins) do not rule out a similarity of ``least``.

    A bin that one set has and the other has not holds a shingle that is not in both, so no pair is lost.
    """
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")))
    left = sketches.select(F.col("id").alias("a"), "n", F.col("bins").alias("x"))
    right = sketches.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bins").alias("y"))
    both = salted_join(pairs.join(right.hint("merge"), "b"), left, ["a"], hot, ["b"])
    alone = lambda x, y: F.expr(" + ".join(f"bit_count({x}[{k}] & ~{y}[{k}])" for k in range(SKETCH)))
    most, all_ = F.least(F.col("n") - alone("x", "y"), F.col("m") - alone("y", "x")), F.col("n") + F.col("m")
    return both.where((all_ == 0) | (most / F.greatest(all_ - most, F.lit(1)) >= least)).select("a", "b")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``id``, ``text`` -> ``id``, ``sid`` (a number of the row), ``sh``: the distinct ``shingle``-word shingles as numbers
    (fewer words: the whole sequence)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = W.split(batch.column("text"))
            found = W.hashes(flat, make=lowered)
            runs = [shingles(found[a:b], shingle) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sid"), pa.array([x.view(np.int64) for x in runs], pa.list_(pa.int64()))], ["id", "sid", "sh"])

    return texts.select("id", F.xxhash64("id", "text").alias("sid"), "text").mapInArrow(lean(compute), "id long, sid long, sh array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The distinct pairs ``a``, ``b`` whose sets have a Jaccard similarity of ``least`` or more. One ``a`` may have most pairs."""
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")))
    left = sets.select(F.col("id").alias("a"), F.col("sh").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("sh").alias("y"))
    both = salted_join(pairs.join(right.hint("merge"), "b"), left, ["a"], hot, ["b"])
    common, all_ = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where((all_ == 0) | (common / F.greatest(all_ - common, F.lit(1)) >= least)).select("a", "b")


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per band from ``rows`` minima of the set's hashes each: two sets share a band's key with the chance J ** rows."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max if len(shingles) else 0, np.uint64)
    with np.errstate(over="ignore"):
        factors = W.mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * W.BASES[0]) | np.uint64(1)
        mixed = W.mixed(shingles * W.BASES[1])
        for k in range(0, len(mixed), 1024):
            least = np.minimum(least, (factors[:, None] * mixed[k : k + 1024]).min(axis=1))
        keys = np.arange(1, bands + 1, dtype=np.uint64)
        for column in least.reshape(bands, rows).T:
            keys = W.mixed((keys ^ column) * W.BASES[1])
    return keys


def prefix_pairs(sets: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """``id``, ``sid``, ``root``, ``sh`` -> ``a`` < ``b``: all pairs with different roots that can have a similarity of ``least``.

    A set's shingles are put in one order, the rarest first; those of one root only come before all, as they match no
    other. Two sets of n >= m shingles that are alike enough share more than ``least / (1 + least) * (n + m)``, so they
    share one among the first few of either, and at its places enough must be left in both: a set is looked for by the
    first ``n - ceil(least * n) + 1`` and found by its first ``m - ceil(2 * least / (1 + least) * m) + 1``. No pair is
    missed. Texts that only have a frame in common, and less than ``least`` of it, start with what is their own and do
    not meet, however many there are. Empty sets are one text and never here.
    """
    tokens = scratch.save(sets.select("id", "sid", "root", F.size("sh").alias("n"), F.explode("sh").alias("t")))
    counts = tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("t", "df")
    counts = scratch.save(counts)
    total = tokens.count()
    hot = counts.where(F.col("df") > max(1, total // 1000))
    listed = salted_join(tokens, counts, ["t"], hot, ["sid"])
    own = Window.partitionBy("sid")
    place = F.row_number().over(own.orderBy("df", "t")) - 1
    ranked = listed.withColumn("of", F.count("*").over(own)).withColumn("pos", place + F.col("n") - F.col("of"))
    ahead = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9)
    share = 2 * least / (1 + least)
    ranked = scratch.save(ranked.where(F.col("pos") <= ahead(least)).select("t", "id", "root", "n", "pos", (F.col("pos") <= ahead(share)).alias("owner")))
    scratch.drop(tokens, counts)
    smaller = ranked.where("owner").select("t", *[F.col(c).alias(f"o_{c}") for c in ("id", "root", "n", "pos")])
    need = F.ceil((F.col("n") + F.col("o_n")) * (share / 2) - 1e-9)
    meet = (F.col("o_root") != F.col("root")) & ((F.col("o_n") < F.col("n")) | ((F.col("o_n") == F.col("n")) & (F.col("o_id") < F.col("id")))) & (F.least(F.col("n") - F.col("pos"), F.col("o_n") - F.col("o_pos")) >= need)
    pairs = ranked.alias("v").hint("merge").join(smaller.alias("s"), (F.col("v.t") == F.col("s.t")) & meet)
    return pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, views: int = 30, distance: int = 2, most_bits: int = 14, together: int = 3) -> DataFrame:
    """Groups of documents that are like one another: ``shingle``-word sets, lower-cased in A-Z, of similarity ``least``.

    Texts meet by SimHash alone: each has ``views`` independent prints of its words, and a print its own anchor and all
    anchors within ``distance`` beyond the covering radius, as in ``links``. First each text is compared with the smallest
    document at each of its own anchors, which folds large groups with few pairs a text. Then every text is looked for at
    all anchors near its prints and compared with each text of another group whose own anchor is there, folded ones too.
    So all pairs are found whose prints differ in ``distance`` bits or fewer in any view, and most of those that differ in
    more. At most ``most_bits`` bits may differ in that view, and the exact similarity decides. Anchors are taken
    ``together`` views at a time; a bitmap of those that any text holds goes to the tasks, so that only these are
    shuffled. Copies of a text are its first document's. No pair below ``least`` is linked.

    Returns doc_id, component_id (the smallest doc_id reachable by links, itself included) of the documents that have a
    link. Rows of one doc_id are one document; rows without a doc_id have no links; null, empty and blank texts are like
    each other; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = W.split(batch.column("text"))
            found = W.hashes(flat, make=lowered)
            runs = [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            fps, sets = [bag_prints(x, views).view(np.int64) for x in runs], [shingles(x, shingle) for x in runs]
            made = [pa.array(fps, pa.list_(pa.int64())), pa.array(map(len, sets), pa.int64()), pa.array(map(sketch, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dig"), *made], ["id", "dig", "prints", "n", "bins"])

    def at_anchors(table: DataFrame, near: bool, first: int, n: int, taken: bytes | None = None) -> DataFrame:
        """anchor (with the number of its view), id, root, fp: own anchors or, if ``near``, all near ones that are ``taken``, in ``n`` views from ``first``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = unpacked(taken, n) if taken is not None else None
            for batch in batches:
                prints = batch.column("prints").flatten().to_numpy().reshape(-1, views)[:, first : first + n]
                ids, roots = batch.column("id").to_numpy(), batch.column("root").to_numpy()
                for k in range(0, len(ids), 1000):
                    values = np.ascontiguousarray(prints[k : k + 1000]).ravel()
                    keys = np.arange(len(values))
                    if near:
                        keys, anchors = near_anchors(values.view(np.uint64), distance)
                    else:
                        anchors = own_anchor(values.view(np.uint64))
                    if held is not None:
                        at = anchor_places(anchors)
                        on = np.flatnonzero(held[keys % n, at >> 3] >> (at & 7).astype(np.uint8) & 1)
                        keys, anchors = keys[on], anchors[on]
                    view, row = (keys % n + first) << 2 * BITS, keys // n + k
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors | view, ids[row], roots[row], values[keys])], ["anchor", "id", "root", "fp"])

        return table.select("id", "root", "prints").mapInArrow(lean(run), "anchor long, id long, root long, fp long")

    printed = scratch.save(texts.withColumn("dig", digest(F.col("text"))).mapInArrow(lean(compute), "id long, dig binary, prints array<long>, n long, bins array<long>"))
    firsts = scratch.save(printed.groupBy("dig").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("prints", "n", "bins")]))
    hot = hot_keys(printed.groupBy("dig").agg(F.count("*").alias("n")))
    copies = scratch.save(hot_join(printed.select("dig", "id"), firsts.select("dig", F.col("id").alias("first")), ["dig"], hot).where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")))
    scratch.drop(printed)

    owners = scratch.save(at_anchors(firsts.withColumn("root", F.col("id")), False, 0, views).select("anchor", "id", "fp"))
    heads = scratch.save(owners.groupBy("anchor").agg(F.min(F.struct("id", "fp")).alias("head"), F.count("*").alias("n")).where("n > 1"))
    beside = hot_join(owners, heads.select("anchor", "head"), ["anchor"], hot_keys(heads)).where(f"head.id < id and bit_count(head.fp ^ fp) <= {most_bits}")
    stars = scratch.save(beside.select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct())
    scratch.drop(owners, heads)

    def checked(pairs: DataFrame) -> DataFrame:
        # Short sketches go with all pairs, whole sets only with those that these leave.
        pairs = scratch.save(possible(pairs, firsts.select("id", "n", "bins"), least))
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return similar(pairs, scratch.save(shingle_sets(texts.join(asked.hint("merge"), "id", "left_semi"), shingle)), least)

    stars = scratch.save(checked(stars))
    roots = connected(stars, scratch).withColumnRenamed("node", "id")
    rooted = scratch.save(firsts.join(roots.hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "prints"))
    found = []
    for first in range(0, views, together):
        n = min(together, views - first)
        held = at_anchors(rooted, False, first, n)
        # Where a group meets itself nothing is listed: first the other groups of an anchor are named, then their texts.
        groups = held.select("anchor", F.col("root").alias("other")).distinct()
        asks = at_anchors(rooted, True, first, n, held_anchors(held, first, n)).join(groups.hint("shuffle_hash"), "anchor").where("root <> other").select("anchor", "other", "id", "fp")
        texts_there = held.select("anchor", F.col("root").alias("other"), F.col("id").alias("o_id"), F.col("fp").alias("o_fp"))
        met = asks.join(texts_there.hint("merge"), ["anchor", "other"]).where(f"bit_count(fp ^ o_fp) <= {most_bits}")
        found.append(scratch.save(met.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()))
    more = scratch.save(functools.reduce(DataFrame.unionByName, found).distinct())
    roots = connected(copies.unionByName(stars).unionByName(checked(more)), scratch)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
