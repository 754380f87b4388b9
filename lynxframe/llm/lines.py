"""Line de-duplication by pairwise patience alignment (operator 4)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.llm.common import NO_ID, Scratch, hot_join, hot_keys, lean, salted_join, text_or_empty


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), ascending in both: equal heads and tails, then the longest ascending run of the
    lines that either side has once, and the same again between those."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {x: n for n, x in enumerate(b[k:m], k) if once_b[x] == 1 and once_a.get(x) == 1}
        pairs = [(n, place[x]) for n, x in enumerate(a[i:j], i) if x in place]
        # Longest ascending run of the places in b.
        tops: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for n, (_, y) in enumerate(pairs):
            at = bisect_left(tops, y)
            back.append(last[at - 1] if at else -1)
            tops[at : at + 1] = [y]
            last[at : at + 1] = [n]
        n, chain = (last[-1] if last else -1), []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if chain:
            edges = [(i - 1, k - 1), *chain[::-1], (j, m)]
            out += chain
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def runs(lines: list[int], words: list[int], least_words: int) -> list[tuple[int, int, int]]:
    """(key, from, to) of the shortest runs of adjacent lines that reach ``least_words``, from each line with words on and
    up to each line with words. Every block of as many words is made up of such runs, but for blank lines at its ends."""
    upto = [0, *accumulate(words)]
    found = set()
    for at, n in enumerate(words):
        if n:
            end = bisect_left(upto, upto[at] + least_words)
            if end < len(upto):
                found.add((at, end))
            if upto[at + 1] >= least_words:
                found.add((bisect_right(upto, upto[at + 1] - least_words) - 1, at + 1))
    keys = np.array(lines, np.int64)
    return [(xxhash.xxh64_intdigest(keys[i:j].tobytes()) - (1 << 63), i, j) for i, j in sorted(found)]


def _blocks(pairs: list[tuple[int, int]], words_b: list[int], least_words: int) -> set[int]:
    """Places of b in the blocks of an alignment: pairs that follow on in both, ``least_words`` words or more, from a line
    with words to a line with words."""
    out: set[int] = set()
    block: list[tuple[int, int]] = []
    for pair in [*pairs, (-9, -9)]:
        if block and (pair[0] != block[-1][0] + 1 or pair[1] != block[-1][1] + 1):
            worded = [y for _, y in block if words_b[y]]
            if sum(words_b[y] for y in worded) >= least_words:
                out.update(range(worded[0], worded[-1] + 1))
            block = []
        block.append(pair)
    return out


def common_blocks(a: list[int], words_a: list[int], b: list[int], words_b: list[int], least_words: int) -> list[int]:
    """Places of the lines of b in common blocks of an alignment with a. A block: lines that follow on in both,
    ``least_words`` words or more, from a line with words to a line with words.

    First both are aligned whole. An alignment keeps the order of both, so it passes blocks by that changed places, that b
    has once more or whose lines recur; where b still has a run of lines that a has, the stretch of b around it that is
    left is aligned again with a from that run's place on, forwards and backwards. The runs only say where; what goes are
    the blocks that patience aligns.
    """
    gone = _blocks(patience(a, b), words_b, least_words)
    place: dict[int, int] = {}
    for key, i, _ in runs(a, words_a, least_words):
        place.setdefault(key, i)
    for key, i, j in runs(b, words_b, least_words):
        at = place.get(key)
        if at is None or gone.issuperset(range(i, j)):
            continue
        low, high = i, j
        while low and low - 1 not in gone:
            low -= 1
        while high < len(b) and high not in gone:
            high += 1
        from_a = max(at - (i - low), 0)
        before = [(x + from_a, y + low) for x, y in patience(a[from_a:at], b[low:i])]
        after = [(x + at, y + i) for x, y in patience(a[at : at + high - i], b[i:high])]
        gone |= _blocks([*before, *after], words_b, least_words)
    return sorted(gone)


def _blank_free(line: str) -> str:
    return " ".join(line.split())


LINES = "oid long, tie long, lines array<long>, words array<int>, runs array<long>"


def with_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and what orders documents: oid (null ids last), then tie (a hash of the text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return base.withColumn("oid", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("tie", F.xxhash64("text"))


def removed_lines(base: DataFrame, scratch: Scratch, least_words: int) -> DataFrame:
    """oid, tie, gone: the lines to delete, by place, of the documents that lose some."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[_blank_free(x) for x in t.split("\n")] for t in batch.column("text").to_pylist()]
            keys = [np.fromiter((xxhash.xxh64_intdigest(x) for x in r), np.uint64, len(r)).view(np.int64) for r in rows]
            words = [[x.count(" ") + 1 if x else 0 for x in r] for r in rows]
            found = [sorted({x for x, _, _ in runs(k, w, least_words)}) for k, w in zip(keys, words, strict=True)]
            lists = [pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("oid"), batch.column("tie"), *lists], ["oid", "tie", "lines", "words", "runs"])

    order = F.struct("oid", "tie")
    # Equal rows are one document; equal texts under several ids are several.
    docs = scratch.save(base.select("oid", "tie", "text").mapInArrow(lean(lines), LINES).groupBy("oid", "tie").agg(F.first("lines").alias("lines"), F.first("words").alias("words"), F.first("runs").alias("runs")))
    # Every later document that has a run goes with the first one that has it: a pair a row, however frequent the run.
    marks = scratch.save(docs.select(order.alias("b"), F.explode("runs").alias("run")))
    firsts = scratch.save(marks.groupBy("run").agg(F.count("*").alias("n"), F.min("b").alias("a")).where("n > 1"))
    pairs = hot_join(marks, firsts.select("run", "a"), ["run"], hot_keys(firsts)).where("a < b").select(F.col("a.oid").alias("aoid"), F.col("a.tie").alias("atie"), F.col("b.oid").alias("boid"), F.col("b.tie").alias("btie")).distinct()
    pairs = scratch.save(pairs)
    scratch.drop(marks, firsts)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(n).to_pylist() for n in ("alines", "awords", "blines", "bwords")]
            gone = [common_blocks(*x, least_words) for x in zip(*c, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("boid"), batch.column("btie"), pa.array(gone, pa.list_(pa.int32()))], ["oid", "tie", "gone"])

    left = docs.select(F.col("oid").alias("aoid"), F.col("tie").alias("atie"), F.col("lines").alias("alines"), F.col("words").alias("awords"))
    right = docs.select(F.col("oid").alias("boid"), F.col("tie").alias("btie"), F.col("lines").alias("blines"), F.col("words").alias("bwords"))
    # A document that came first with a frequent run is asked for by very many.
    hot = hot_keys(pairs.groupBy("aoid", "atie").agg(F.count("*").alias("n")))
    both = salted_join(pairs.join(right.hint("merge"), ["boid", "btie"]), left, ["aoid", "atie"], hot, ["boid", "btie"])
    cut = scratch.save(both.select("boid", "btie", "alines", "awords", "blines", "bwords").mapInArrow(lean(align, 500), "oid long, tie long, gone array<int>").where("size(gone) > 0"))
    gone = cut.select("oid", "tie", F.explode("gone").alias("g")).distinct().groupBy("oid", "tie").agg(F.array_sort(F.collect_list("g")).alias("gone"))
    return scratch.save(gone)


def line_dedup(docs: DataFrame, least_words: int = 10) -> DataFrame:
    """Delete from later documents the blocks of lines that they share with earlier ones.

    Lines are compared with white space runs taken as one space. A block is a run of adjacent lines with ``least_words``
    words or more, from a line with words to a line with words. Documents overlap where they share the hash of such a
    line or run of lines, which is rare as most lines are: of all holders of one each is paired with the first document
    that has it, so a frequent line gives one pair a holder and no two holders of a rare one are left apart. Each pair is
    aligned with patience diff, and the aligned common blocks are deleted from the document with the larger doc_id; where
    blocks changed places or recur, the pair is aligned again at the runs that are left. A hash look-up of runs alone would
    delete nothing else here, but that rests on the alignments: a run of equal hash that does not align stays. All is
    judged on the
    input.

    Returns the input's columns, with ``text`` without the deleted lines, and n_lines, n_removed (long) after them.
    Null and empty texts stay as they are with 1 empty line; repeated rows are one document and fare alike; rows of one
    doc_id with different texts are ordered by a hash of the text; null ids come last. Input columns called n_lines or
    n_removed are replaced; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = removed_lines(with_order(docs), scratch, least_words)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("oid"), F.xxhash64(text_or_empty()).alias("tie"))
    joined = keyed.join(gone.hint("merge"), ["oid", "tie"], "left")
    text = F.col("row.text").cast("string")
    lines = F.split(text, "\n", -1)
    stay = F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long").alias("n_lines")
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")
    rest = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(stay, "\n"))
    return joined.select(*[(rest if c == "text" else F.col(f"row.{c}")).alias(c) for c in columns], n_lines, n_removed)
