"""Ranked lexical search over a length-stratified index (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.llm import words as W
from lynxframe.llm.common import NO_ID, Scratch, lean, tasks_for

#: ASCII letters and digits and all that is not ASCII make up terms; of letters only A to Z are lower-cased.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

FORWARD = "doc_id long, n long, terms array<long>, tfs array<int>"
INDEX = "block long, m long, ids array<long>, term long, ords array<int>, tfs array<int>"
FOUND = "item_id long, doc_id long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"

#: Postings of a block: what a task holds at a time, a few ten MB.
BLOCK = 1 << 20
#: Items of one pass over the index, which go to every task.
ITEMS = 2048


def folded(texts: pa.Array) -> pa.Array:
    """The texts with every byte outside of a term as a space and A to Z in lower case; null texts are empty."""
    t = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(t):
        return t
    bounds = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = t.buffers()[2]
    own = data.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes().translate(_TERM) if data is not None else b""
    return pa.LargeStringArray.from_buffers(len(t), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(own))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, number of terms, the distinct terms as XXH64 and how often each occurs."""
    for batch in batches:
        flat, bounds = W.split(folded(batch.column(1)))
        keys = W.hashes(flat).view(np.int64)
        distinct, code = np.unique(keys, return_inverse=True)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        pairs, tf = np.unique(owner * max(len(distinct), 1) + code, return_counts=True)
        owner, code = np.divmod(pairs, max(len(distinct), 1))
        starts = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
        terms = pa.ListArray.from_arrays(starts, pa.array(distinct[code], pa.int64()))
        tfs = pa.ListArray.from_arrays(starts, pa.array(tf, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), terms, tfs], ["doc_id", "n", "terms", "tfs"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in a row, and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _block_rows(block: int, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The index rows of documents in the order of m: a row per stratum, then a row per term."""
    strata, at = np.unique(m, return_index=True)
    stratum = np.repeat(np.searchsorted(strata, m), sizes)
    ords = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    order = np.lexsort((-tfs, stratum, terms))
    terms, ords, tfs = terms[order], ords[order], tfs[order]
    first = np.flatnonzero(np.diff(terms, prepend=terms[:1] - 1)) if len(terms) else np.zeros(0, np.int64)
    n, k = len(strata), len(first)
    names = ["block", "m", "ids", "term", "ords", "tfs"]
    of = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids, pa.int64()))
    none = lambda kind, rows: pa.nulls(rows, kind)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(strata, pa.int64()), of, none(pa.int64(), n), none(pa.list_(pa.int32()), n), none(pa.list_(pa.int32()), n)], names)
    cuts = pa.array(np.append(first, len(terms)), pa.int32())
    posts = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (ords, tfs)]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), none(pa.int64(), k), none(pa.list_(pa.int64()), k), pa.array(terms[first], pa.int64()), *posts], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in the order of m -> index rows, block by block."""
    held, n, block = [], 0, TaskContext.get().partitionId() << 32

    def emit():
        (ids, m), (terms, sizes), (tfs, _) = [[np.concatenate(x) for x in zip(*part, strict=True)] for part in zip(*held, strict=True)]
        return _block_rows(block, ids, m, sizes, terms, tfs)

    for batch in batches:
        held.append(((batch.column("doc_id").to_numpy(), batch.column("m").to_numpy()), _lists(batch.column("terms")), _lists(batch.column("tfs"))))
        n += len(held[-1][1][0]) + batch.num_rows
        if n >= BLOCK:
            yield from emit()
            held, n, block = [], 0, block + 1
    if held:
        yield from emit()


def build_index(docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, int]:
    """The index of all rows of ``docs`` (doc_id, text) and N, the number of rows with a term.

    One table. Documents are sorted by their normaliser m and cut into blocks of about a million postings; the documents
    of a block that have one m are a stratum. A row with ``ids``: a stratum (block, m, the ids of its documents; strata
    follow on in the order of m, so a document's ordinal in the block is its place in all their ids). A row with ``term``:
    the term's postings in the block, by stratum and within it from the greatest tf down (``ords``, ``tfs``). Terms are
    their XXH64. A stratum of any size is spread over blocks, as rows are dealt by m and row.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "index")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    forward = scratch.save(base.mapInArrow(lean(term_counts), FORWARD).withColumn("row", F.monotonically_increasing_id()))
    total, some, postings = forward.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.sum(F.size("terms"))).first()
    m = F.expr(f"10 + (90 * n * {some}L) div {total}L") if total else F.lit(10).cast("long")
    parts = tasks_for(spark, postings or 0, 2 * BLOCK)
    ordered = forward.withColumn("m", m).repartitionByRange(parts, "m", "row").sortWithinPartitions("m", "row")
    index = scratch.save(ordered.select("doc_id", "m", "terms", "tfs").mapInArrow(lean(_blocks), INDEX))
    scratch.drop(forward)
    return index, some or 0


class _Best:
    """The k best documents of each item so far: by score, equal ones by id."""

    def __init__(self, items: list[np.ndarray], vocabulary: np.ndarray, weights: np.ndarray, k: int):
        self.items, self.vocabulary, self.weights, self.k = items, vocabulary, weights, k
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]

    def least(self, item: int) -> int:
        scores = self.kept[item][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.kept[item][0], scores)), np.concatenate((self.kept[item][1], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.kept[item] = scores[order], ids[order]

    def visit(self, m: np.ndarray, sizes: np.ndarray, ids: np.ndarray, terms: np.ndarray, lengths: np.ndarray, ords: np.ndarray, tfs: np.ndarray) -> None:
        """Score the documents of one block, strata with the highest bounds first."""
        stratum = np.repeat(np.arange(len(m)), sizes)[ords]
        term = np.repeat(np.arange(len(terms)), lengths)
        # Postings of one term, stratum and tf are a run, and have one impact.
        fresh = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(stratum, prepend=-1) != 0) | (np.diff(tfs, prepend=0) != 0))
        run_length = np.diff(np.append(fresh, len(ords)))
        run_term, run_stratum, tf = term[fresh], stratum[fresh], tfs[fresh].astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[run_stratum])
        head = (np.diff(run_term, prepend=-1) != 0) | (np.diff(run_stratum, prepend=-1) != 0)
        of = np.searchsorted(self.vocabulary, terms)
        value = self.weights[of][run_term] * impact
        begin, end = np.searchsorted(run_term, np.arange(len(terms))), np.searchsorted(run_term, np.arange(len(terms)), "right")
        place = np.full(len(self.vocabulary), -1)
        place[of] = np.arange(len(terms))
        for item, asked in enumerate(self.items):
            there = place[asked]
            there = there[there >= 0]
            if not len(there):
                continue
            runs = np.concatenate([np.arange(begin[t], end[t]) for t in there])
            bound = np.zeros(len(m), np.int64)
            tops = runs[head[runs]]
            np.add.at(bound, run_stratum[tops], value[tops])
            order = np.argsort(-bound, kind="stable")
            # The first strata that hold k documents give the score to beat; then all that can reach it.
            first = order[: int(np.searchsorted(np.cumsum(sizes[order]), self.k)) + 1]
            seen = np.zeros(len(m), bool)
            for strata in (first, order):
                now = np.zeros(len(m), bool)
                now[strata] = bound[strata] >= self.least(item)
                now &= ~seen
                seen |= now
                chosen = runs[now[run_stratum[runs]]]
                if not len(chosen):
                    continue
                n = run_length[chosen]
                at = np.repeat(fresh[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
                score = np.zeros(len(ids), np.int64)
                np.add.at(score, ords[at], np.repeat(value[chosen], n))
                good = np.flatnonzero(score >= self.least(item))
                self.add(item, score[good], ids[good])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by block -> a table per block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        blocks = batch.column("block").to_numpy()
        for cut in [*np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]:
            part = batch.slice(at, cut - at)
            if held and part.num_rows and held[-1].column("block")[0] != part.column("block")[0]:
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10, per_pass: int = ITEMS) -> DataFrame:
    """The ``k`` best documents of each item (item_id, text) with a score above 0: item_id, rank, doc_id, score.

    Items go in passes of about ``per_pass`` over the rows of their terms in the index. A task keeps the k best documents
    that it has seen of each item: of a block's strata, those of the highest bound (the sum of the greatest impacts of the
    item's terms) are scored first, and strata whose bound is below the k-th best score are not scored at all. What the
    tasks keep is ranked once more. The texts of rows of one item_id are one item; null items have no terms.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "search")
    base = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = scratch.save(base.mapInArrow(lean(term_counts), FORWARD).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where("size(terms) > 0"))
    passes = -(-asked.count() // per_pass)
    found = [spark.createDataFrame([], FOUND)]
    for number in range(passes):
        part = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == number)
        rows = part.collect()
        terms = F.broadcast(part.select(F.explode("terms").alias("term")).distinct())
        posts = index.where("term is not null").join(terms, "term", "left_semi")
        counts = posts.groupBy("term").agg(F.sum(F.size("ords")).alias("df")).collect()
        vocabulary = np.sort(np.array([r.term for r in counts], np.int64))
        df = {r.term: r.df for r in counts}
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in vocabulary.tolist()], np.int64)
        names = [r.doc_id for r in rows]
        places = [np.searchsorted(vocabulary, np.array([t for t in r.terms if t in df], np.int64)) for r in rows]

        def run(batches: Iterator[pa.RecordBatch], names=names, places=places, vocabulary=vocabulary, weights=weights) -> Iterator[pa.RecordBatch]:
            best = _Best(places, vocabulary, weights, k)
            for table in _by_block(batches):
                of, posted = table.filter(pc.is_valid(table["ids"])).combine_chunks(), table.filter(pc.is_valid(table["term"])).combine_chunks()
                if posted.num_rows:
                    (ids, sizes), (ords, lengths), (tfs, _) = [_lists(t[c].combine_chunks()) for t, c in ((of, "ids"), (posted, "ords"), (posted, "tfs"))]
                    best.visit(of["m"].to_numpy(), sizes, ids, posted["term"].to_numpy(), lengths, ords, tfs)
            for at in range(0, len(names), 256):
                kept = best.kept[at : at + 256]
                out = [np.concatenate([x[c] for x in kept]) for c in (1, 0)]
                own = np.repeat(np.arange(len(kept)), [len(x[0]) for x in kept])
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 256], pa.int64()).take(pa.array(own)), *[pa.array(x, pa.int64()) for x in out]], ["item_id", "doc_id", "score"])

        both = posts.select("block", "m", "ids", "term", "ords", "tfs").unionByName(index.where("ids is not null"))
        found.append(both.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("term"), "m").mapInArrow(lean(run), FOUND))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and characters outside of ASCII; A to Z are lower-cased. With N rows that have
    a term, L terms in all and df rows that hold a term, its weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a row of n
    terms has m = 10 + 90 n N div L; its score is the sum of w * ((10^9 tf) div (1000 tf + 8 m)) over the item's distinct
    terms. Equal scores are ranked by ascending doc_id. All in 64-bit integers.

    Null and empty texts have no terms and are never found; every row is a document, so repeated rows are found, and
    counted, as often as they are there; null doc_ids rank last among equal scores; an item without terms, and an empty
    table on either side, give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "ranking")
    index, n_docs = build_index(docs, scratch)
    return search(index, n_docs, items, k)
