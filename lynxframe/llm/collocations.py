"""Phrase collocation mining by dynamic itemset counting (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.llm import words as W
from lynxframe.llm.common import Scratch, lean, text_or_empty

#: Words of a text are set apart by space and tab; the pieces within which phrases lie by these.
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _BREAKS else c for c in range(256))

ENCODED = "shard int, lang string, n long, words array<long>, texts array<string>"
TALLY = "length int, bucket int, keys binary, n binary, bits binary"
#: Fingerprints of one beginning of so many bits are counted together: 256 groups a length.
BUCKET_BITS = 8
#: A task that has spelt so many words forgets them, so its memory is bounded.
MOST_TOLD = 1 << 20
#: Stands in ``shard`` for the rows that spell words.
SPELLING = -1
#: Stands between pieces; no word has it.
BREAK = np.int64(0)


def encode(shards: int):
    """(lang, text) -> rows of ``ENCODED``: each text as the numbers of its words with BREAK between pieces, dealt over
    ``shards`` in turn, and for each batch the words that its numbers stand for. A word's number is the XXH64 of its
    lower-cased bytes, seeded by its language, so equal words of two languages are two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "lang", "n", "words", "texts"]
        told = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("text").cast(pa.large_string())
            bounds = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
            data = t.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes().translate(_FOLD) if t.buffers()[2] is not None else b""
            own = pa.LargeStringArray.from_buffers(len(t), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(data))
            split = pc.split_pattern(own, "\n")
            pieces, per_text = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
            flat, cuts = W.split(pieces)
            per_piece = np.diff(cuts)
            langs, lang_of = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            text_of = np.repeat(np.arange(batch.num_rows), per_text)
            coded = flat.dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            spelt, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            of = np.repeat(lang_of[text_of], per_piece)
            key, width = of * max(len(spelt), 1) + code, len(langs) * max(len(spelt), 1)
            if width <= 4 * len(key):
                there = np.zeros(width, bool)
                there[key] = True
                pairs, place = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
            else:
                pairs, place = np.unique(key, return_inverse=True)
            seeds = [xxhash.xxh64_intdigest(x) for x in langs]
            owner, code = np.divmod(pairs, max(len(spelt), 1))
            number = np.fromiter((xxhash.xxh64_intdigest(spelt[c], seeds[o]) or 1 for o, c in zip(owner.tolist(), code.tolist(), strict=True)), np.uint64, len(pairs)).view(np.int64)
            # A BREAK behind each piece.
            out = np.full(len(flat) + len(per_piece), BREAK)
            out[np.arange(len(flat)) + np.repeat(np.arange(len(per_piece)), per_piece)] = number[place]
            upto = np.append(0, np.cumsum(per_piece + 1))[np.append(0, np.cumsum(per_text))]
            n_words = np.diff(np.append(0, np.cumsum(per_piece))[np.append(0, np.cumsum(per_text))])
            shard = np.arange(batch.num_rows, dtype=np.int32) % shards
            none = pa.nulls(batch.num_rows, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("lang"), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(out, pa.int64())), none], names)
            # Words that this task has not spelt yet, or not since it last forgot.
            new = np.flatnonzero(~np.isin(number, told))
            if len(new):
                told = np.concatenate((told if len(told) < MOST_TOLD else told[:0], number[new]))
                used, k = np.unique(owner[new], return_index=True)
                ends = pa.array(np.append(k, len(new)), pa.int32())
                said = pa.array([spelt[c] for c in code[new].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), SPELLING, np.int32)), pa.array(langs[used].tolist(), pa.string()), pa.array(np.zeros(len(used), np.int64)), pa.ListArray.from_arrays(ends, pa.array(number[new], pa.int64())), pa.ListArray.from_arrays(ends, said)], names)

    return run


def _fingerprints(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number for the phrase of ``length`` words from each place on, spread over all its bits."""
    return W.windows(words.view(np.uint64), length)


class Filter:
    """A set of fingerprints as a bitmap over their first bits: it holds all that were put in, and few others."""

    def __init__(self, bits: np.ndarray | None, size: int):
        self.bits, self.shift = bits, np.uint64(64 - size.bit_length() + 1)

    def holds(self, fingerprints: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(fingerprints), bool)
        at = (fingerprints >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1

    def same(self, other: Filter) -> bool:
        return (self.bits is None) == (other.bits is None) and (self.bits is None or bool(np.array_equal(self.bits, other.bits)))


def active_phrases(words: np.ndarray, longest: int, first: bool, now: dict[int, Filter], before: dict[int, Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, fingerprints) of the phrases that are active in this scan of their shard.

    A phrase of two or more words is active once ``now`` holds both its parts that lack one word, and was counted in the
    last scan of this shard if ``before`` held them then; so each shard counts it in exactly one scan.
    """
    there, prints = words != BREAK, _fingerprints(words, 1)
    if first:
        at = np.flatnonzero(there)
        yield 1, at, prints[at]
    for length in range(2, min(longest, len(words)) + 1):
        n = len(words) - length + 1
        on, done = now[length - 1].holds(prints), before[length - 1].holds(prints)
        there = there[:n] & (words[length - 1 :] != BREAK)
        at = np.flatnonzero(there & on[:n] & on[1:] & ~(done[:n] & done[1:]))
        prints = _fingerprints(words, length)
        yield length, at, prints[at]


def count_step(longest: int, first: bool, now: dict[int, Filter], before: dict[int, Filter]):
    """Rows of a shard -> counts of its active phrases by fingerprint, a row a length and bucket of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words").flatten().to_numpy(zero_copy_only=False)
            for length, _, prints in active_phrases(words, longest, first, now, before):
                keys, n = np.unique(prints, return_counts=True)
                if len(keys):
                    yield _tally(length, keys, n)

    return run


def _tally(length: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of ``TALLY`` for sorted keys: a bucket is the keys of one beginning."""
    bucket = (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    of, at = np.unique(bucket, return_index=True)
    ends = pa.array(np.append(at, len(keys)) * 8, pa.int64())
    lists = [pa.Array.from_buffers(pa.large_binary(), len(of), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(x, np.int64).tobytes())]) for x in (keys.view(np.int64), n)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(of), length, np.int32)), pa.array(of), *[x.cast(pa.binary()) for x in lists], pa.nulls(len(of), pa.binary())], ["length", "bucket", "keys", "n", "bits"])


def merge_tallies(least: int, size: int):
    """All rows of one length and bucket -> one, with the bits of the keys that have reached ``least``."""

    def run(table: pa.Table) -> pa.Table:
        length, bucket = table["length"][0].as_py(), table["bucket"][0].as_py()
        keys, n = [np.frombuffer(b"".join(x for x in table[c].to_pylist()), kind) for c, kind in (("keys", np.uint64), ("n", np.int64))]
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
        keys, n = keys[first], np.add.reduceat(n, first)
        own = size >> BUCKET_BITS
        at = (keys[n >= least] >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64) - bucket * own
        bits = np.zeros(own, np.uint8)
        bits[at] = 1
        there = np.packbits(bits, bitorder="little").tobytes() if len(at) else None
        return pa.table({"length": pa.array([length], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "bits": pa.array([there], pa.binary())})

    return run


def read_filters(counted: DataFrame, longest: int, size: int) -> dict[int, Filter]:
    """The filters of all lengths; ``size`` bits a length come to the driver, however many phrases there are."""
    out = {x: Filter(None, size) for x in range(1, longest + 1)}
    own = size >> BUCKET_BITS >> 3
    for row in counted.where("bits is not null").select("length", "bucket", "bits").toLocalIterator():
        if out[row.length].bits is None:
            out[row.length].bits = np.zeros(size >> 3, np.uint8)
        out[row.length].bits[row.bucket * own : (row.bucket + 1) * own] = np.frombuffer(row.bits, np.uint8)
    return out


def exact_counts(longest: int, reached: dict[int, Filter]):
    """Rows of all shards -> (w0, w1, ..., n) of the phrases whose fingerprint has reached the threshold; null words end them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words").flatten().to_numpy(zero_copy_only=False)
            distinct, ids = np.unique(words, return_inverse=True)
            there, code, at = words != BREAK, ids, np.arange(len(words))
            for length in range(1, min(longest, len(words)) + 1):
                there = there[: len(words) - length + 1] & (words[length - 1 :] != BREAK)
                # Of the places of reached phrases one word shorter those where this length has reached it too.
                at = at[at < len(there)]
                at = at[there[at] & reached[length].holds(_fingerprints(words, length)[at])]
                if not len(at):
                    break
                # Numbers of phrases within the batch: the phrase less its last word, and that word.
                _, first, code_at, n = np.unique(code[at] * len(distinct) + ids[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
                code = np.zeros(len(words), np.int64)
                code[at] = code_at
                phrase = [pa.array(words[at[first] + k], pa.int64()) for k in range(length)] + [pa.nulls(len(n), pa.int64())] * (longest - length)
                yield pa.RecordBatch.from_arrays([*phrase, pa.array(n, pa.int64())], [*[f"w{k}" for k in range(longest)], "n"])

    return run


def frequent_phrases(encoded: DataFrame, shards: int, longest: int, least: int, scratch: Scratch, size: int = 1 << 24) -> DataFrame:
    """All phrases of 1 to ``longest`` words that occur ``least`` times or more: words, n (exact).

    Dynamic itemset counting. Scan s reads shard s mod ``shards``. Words are counted in the first cycle; a longer phrase
    is taken up as soon as both its parts that lack one word have reached ``least`` in the shards read so far, in the
    middle of a cycle, and stays until it has met each shard once. The cycles end where no scan has anything to count that
    was not active a cycle before. Counts are kept by 64-bit fingerprint, in arrays a bucket of them; which have reached
    ``least`` goes to the scans as a bitmap of ``size`` bits a length. What a bitmap lets pass for nothing, or a fingerprint
    that two phrases share, only adds to what is looked at: one scan at the end counts by their words all phrases whose
    fingerprint has reached ``least``, and these counts decide.
    """
    none = {x: Filter(None, size) for x in range(1, longest + 1)}
    filters: list[dict[int, Filter]] = []
    now, counted, s = none, None, 0
    while True:
        before = filters[s - shards] if s >= shards else none
        if s >= shards and all(now[x].same(before[x]) for x in range(1, longest)):
            break
        filters.append(now)
        step = encoded.where(F.col("shard") == s % shards).select("words").mapInArrow(lean(count_step(longest, s < shards, now, before), 4000), TALLY)
        # A length is settled once its last cycle is over: its filter stays, its counts are not needed any more.
        opened = None if counted is None else counted.where(F.col("length") > s // shards).withColumn("bits", F.lit(None).cast("binary"))
        merged = scratch.save((step if opened is None else opened.unionByName(step)).groupBy("length", "bucket").applyInArrow(merge_tallies(least, size), TALLY))
        if counted is not None:
            scratch.drop(counted)
        counted = merged
        now = {x: now[x] if x <= s // shards else f for x, f in read_filters(counted, longest, size).items()}
        s += 1
    scratch.drop(counted)
    found = encoded.where(F.col("shard") != SPELLING).select("words")
    columns = [f"w{k}" for k in range(longest)]
    exact = found.mapInArrow(lean(exact_counts(longest, now), 4000), ", ".join(f"{c} long" for c in [*columns, "n"]))
    reached = exact.groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return scratch.save(reached.select(F.array_compact(F.array(*columns)).alias("words"), "n"))


def _drop_inside(candidates: DataFrame, longest: int, percent: int) -> DataFrame:
    """``candidates`` (words, a, ...) without those that lie in a longer one that occurs ``percent`` of their times or more."""
    if longest < 3:
        return candidates
    within = [F.expr(f"if(size(words) > {k}, transform(sequence(1, size(words) - {k} + 1), i -> slice(words, i, {k})), array())") for k in range(2, longest)]
    around = candidates.select(F.explode(F.array_distinct(F.concat(*within))).alias("words"), F.col("a").alias("around")).groupBy("words").agg(F.max("around").alias("around"))
    held = candidates.join(around.hint("merge"), "words", "left")
    return held.where(F.col("around").isNull() | (F.lit(100).cast("decimal(38,0)") * F.col("around") < F.lit(percent).cast("decimal(38,0)") * F.col("a"))).drop("around")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50, shards: int = 4) -> DataFrame:
    """The first ``top`` phrases of each language by how much more often their words meet than by themselves.

    Texts (``text``, ``lang``) are lower-cased in A to Z, split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
    at space and tab. Candidates are the phrases of 2 to ``longest`` words that occur ``least`` times or more within pieces
    (``a``). Cut after its first k words, a phrase has l and r occurrences of its parts and the score floor(10^6 a a / (l r));
    its lowest cut counts, of equal ones that of the smallest k. A candidate that lies in a longer one which occurs in at
    least ``inside_percent`` of its places is dropped. Ranks go by score and a, both falling, then by phrase in byte order;
    ``n`` is the number of all words of the language. Products are decimals of 38 digits.

    Returns lang, rank, phrase, a, l, r, n, score. Null texts are empty; a null language is ``und``; repeated rows count as
    often as they are there; texts of any length are counted whole; an empty table gives no rows; other columns are not
    read. Words are told apart by the XXH64 of their bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    path = scratch.path()
    base.mapInArrow(lean(encode(shards), 4000), ENCODED).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    encoded = spark.read.schema("lang string, n long, words array<long>, texts array<string>, shard int").parquet(path)
    phrases = frequent_phrases(encoded, shards, longest, least, scratch)

    totals = encoded.where(F.col("shard") != SPELLING).groupBy("lang").agg(F.sum("n").alias("n"))
    single = phrases.where("size(words) = 1").select(F.col("words")[0].alias("word"))
    spelt = encoded.where(F.col("shard") == SPELLING).select("lang", F.explode(F.arrays_zip("words", "texts")).alias("s")).select("lang", F.col("s.words").alias("word"), F.col("s.texts").alias("said"))
    spelt = scratch.save(spelt.groupBy("word").agg(F.first("lang").alias("lang"), F.first("said").alias("said")).join(single, "word", "left_semi"))

    a = phrases.where("size(words) > 1").withColumnRenamed("n", "a")
    cuts = a.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(words, 1, k)")).withColumn("right", F.expr("slice(words, k + 1, size(words) - k)"))
    # Phrases that begin, or end, with one frequent word are many; adaptive execution splits such partitions of these merge joins.
    cuts = cuts.join(phrases.select(F.col("words").alias("left"), F.col("n").alias("l")).hint("merge"), "left").join(phrases.select(F.col("words").alias("right"), F.col("n").alias("r")).hint("merge"), "right")
    wide = "decimal(38,0)"
    scored = cuts.withColumn("score", F.expr(f"(cast(1000000 as {wide}) * cast(a as {wide}) * cast(a as {wide})) div (cast(l as {wide}) * cast(r as {wide}))"))
    best = scored.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("words", "a", "c.score", "c.l", "c.r")
    kept = _drop_inside(best, longest, inside_percent)

    words = kept.select("words", "a", "l", "r", "score", F.posexplode("words").alias("at", "word")).join(spelt.hint("merge"), "word")
    named = words.groupBy("words", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The first of 64 parts of a language hold the first of all.
    salted = named.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(64)))
    few = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
