"""Rules over tables of records: identities, duplicates, decisions, slices, yields, coverage, windows of files, nested rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.functions import rules as R
from lynxframe.operators import blocks


def latest(rows: DataFrame, order: list[str], n: int, key: str | None = None, only=None, most: int = 1000) -> DataFrame:
    """The last ``n`` rows by ``order`` (clamped to 1 ... ``most``), of the one ``key`` value ``only`` if that is given."""
    of = rows if key is None else rows.where(F.col(key) == only)
    return of.orderBy(*[F.desc(c) for c in order]).limit(max(1, min(n, most)))


def page_after(rows: DataFrame, sequence: str, cursor: int, n: int, most: int = 1000) -> DataFrame:
    """The next ``n`` rows (at most ``most``) whose ``sequence`` is greater than ``cursor``; its last one is the next cursor."""
    return rows.where(F.col(sequence) > cursor).orderBy(sequence).limit(max(1, min(n, most)))


def by_id(rows: DataFrame, key: str, wanted) -> DataFrame:
    """The rows of one id, by a filter that reaches the scan."""
    return rows.where(F.col(key) == F.lit(wanted))


def union_of(sources: dict[str, DataFrame], origin: str = "origin") -> DataFrame:
    """All rows of the sources with the name of theirs; columns that a source lacks are null."""
    out = None
    for name, rows in sources.items():
        named = rows.withColumn(origin, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def one_each(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row an identity: ``columns`` of its first row by ``order``. Null keys are an identity."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_f")
    return rows.groupBy(*keys).agg(first).select(*keys, "_f.*")


def collapsed(rows: DataFrame, content: list[Column], id_: str, provenance: dict[str, Column]) -> DataFrame:
    """Rows of equal content as one: the content, ``n``, ``first_id`` and, for each name, the distinct values of where they
    came from, in order, joined by a comma."""
    kept = [F.array_join(F.array_sort(F.collect_set(c.cast("string"))), ",").alias(n) for n, c in provenance.items()]
    return rows.groupBy(*content).agg(F.count("*").alias("n"), F.min(id_).alias("first_id"), *kept)


def first_sightings(rows: DataFrame, keys: list[str], order: list[str], id_: str) -> DataFrame:
    """``rows`` with ``first_no`` (``id_`` of the first row of the key by ``order``) and ``duplicate``, whether it is another."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("first_no", F.first(id_).over(w)).withColumn("duplicate", F.row_number().over(w) > 1)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and their number ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def decided(rows: DataFrame, decisions: DataFrame, key: str, decision: Column, pending: str = "pending") -> DataFrame:
    """``rows`` with their ``decision`` (an expression over the columns of ``decisions``), or ``pending`` if there is none."""
    said = decisions.select(F.col(key), F.coalesce(decision, F.lit(pending)).alias("decision"))
    return rows.join(said, key, "left").withColumn("decision", F.coalesce("decision", F.lit(pending)))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key ``seen`` does not have; null keys have not been seen."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def sides(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Each distinct non-null key of both with ``side``: ``both``, or whose only it is, as in ``names``."""
    left, right = (x.select(key).where(F.col(key).isNotNull()).distinct().withColumn(c, F.lit(True)) for x, c in ((a, "_a"), (b, "_b")))
    return left.join(right, key, "full").select(key, F.when(F.col("_a").isNull(), f"{names[1]} only").when(F.col("_b").isNull(), f"{names[0]} only").otherwise("both").alias("side"))


def yields(rows: DataFrame, groups: list[str], label: str) -> DataFrame:
    """``reviewed``, ``positive`` and ``yield_ratio`` of each group; rows without a label are not reviewed."""
    return rows.where(F.col(label).isNotNull()).groupBy(*groups).agg(F.count("*").alias("reviewed"), F.sum(label).alias("positive"), F.round(F.sum(label) / F.count("*"), 6).alias("yield_ratio"))


def coverage(rows: DataFrame, known: DataFrame, key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """How much of each group (and of all, as a null group) is known: documents, reviewed, share, complete; and the keys of
    ``known`` that no row has, which a caller should refuse."""
    ids = known.select(key).where(F.col(key).isNotNull()).distinct()
    n, k = F.count("*"), F.count("_known")
    out = rows.select(key, group).join(ids.withColumn("_known", F.lit(1)), key, "left").rollup(group).agg(n.alias("documents"), k.alias("reviewed"), F.round(k / n, 6).alias("share"), (n == k).alias("complete"))
    return out, ids.join(rows.select(key), key, "left_anti")


def slices(rows: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """``rows`` with ``batch`` (from 0): each key's rows in the order, so many a batch. A key may have any number of rows."""
    placed = blocks.numbered(rows, keys, order)
    return placed.select(*rows.columns, F.floor((F.col("place") - 1) / size).alias("batch"))


def set_ids(rows: DataFrame, keys: list[str], member: str, prefix: str, digits: int = 16) -> DataFrame:
    """``members`` and ``set_id`` of each key: a name from its sorted members, the same whatever their order. A key's members
    meet in one array."""
    name = F.sha2(F.array_join(F.array_sort(F.collect_list(member)).cast("array<string>"), "|"), 256)
    return rows.groupBy(*keys).agg(F.count("*").alias("members"), F.concat(F.lit(prefix), F.substring(name, 1, digits)).alias("set_id"))


def funnel(rows: DataFrame, key: str, ts: str, lives: dict[str, float]) -> DataFrame:
    """One row: ``tracks``, ``raw_rows`` and, for each name, how many tracks lived for so long."""
    per = rows.groupBy(key).agg(F.count("*").alias("_n"), (F.max(ts) - F.min(ts)).alias("_life"))
    return per.agg(F.count("*").alias("tracks"), F.sum("_n").alias("raw_rows"), *[F.count_if(F.col("_life") >= s).alias(n) for n, s in lives.items()])


def voted(rows: DataFrame, keys: list[str], vote: Column, ratio: float = 0.5) -> DataFrame:
    """``share`` of the rows of each key that vote for it, and ``in_mask``, whether that reaches ``ratio``; null votes are against."""
    votes, n = F.count_if(F.coalesce(vote, F.lit(False))), F.count("*")
    return rows.groupBy(*keys).agg((votes / n).alias("share"), (votes >= ratio * n).alias("in_mask"))


def state_counts(rows: DataFrame, groups: list[str], state: Column, id_: str, listed: str) -> tuple[DataFrame, DataFrame]:
    """``n`` and ``first_id`` of each group and state; and the rows in the state ``listed``, to be worked off."""
    marked = rows.withColumn("state", state)
    return marked.groupBy(*groups, "state").agg(F.count("*").alias("n"), F.min(id_).alias("first_id")), marked.where(F.col("state") == listed)


def false_positives(rows: DataFrame, groups: list[str], passed: Column, positive: Column) -> DataFrame:
    """``n``, ``fp`` (passed without being positive) and ``fp_share`` of each group, a stage or a run."""
    fp = F.count_if(passed & ~positive)
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), fp.alias("fp"), (fp / F.count("*")).alias("fp_share"))


def by_method(rows: DataFrame, scores: dict[str, str], both: str, largest: Column) -> DataFrame:
    """Proposals by the method that made them: of two score columns the one that is there, or ``both``: ``n``, ``mean_conf``
    (the first score there is) and ``largest``."""
    (a, first), (b, second) = scores.items()
    method = R.chain((F.col(first).isNull(), b), (F.col(second).isNull(), a), other=both)
    return rows.groupBy(method.alias("method")).agg(F.count("*").alias("n"), F.avg(F.coalesce(first, second)).alias("mean_conf"), F.max(largest).alias("largest"))


def usable_windows(files: DataFrame, tasks: DataFrame, key: str, period: float, begin: float, end: float, least: float) -> DataFrame:
    """What part of each file lies in the window [begin, end) of the periods in which its key has a task: file columns,
    ``block``, ``usable_s`` and ``state`` (whole, partial if under ``least`` seconds, outside).

    files: ``key``, start_s, end_s and any others; tasks: ``key``, block (the number of the period). A file is listed under
    each period that it touches."""
    slot = lambda c: F.floor(F.col(c) / period)
    met = files.withColumn("block", F.explode(F.sequence(slot("start_s"), slot("end_s")))).join(tasks.select(key, "block").distinct(), [key, "block"])
    length = F.least("end_s", F.col("block") * period + end) - F.greatest("start_s", F.col("block") * period + begin)
    state = F.when(length <= 0, "outside").when(length < least, "partial").otherwise("whole")
    return met.select(*files.columns, "block", F.greatest(length, F.lit(0.0)).alias("usable_s"), state.alias("state"))


def novelty(rows: DataFrame, known: DataFrame, group: str, id_: str, vector: str, tile: tuple[int, int] = (20_000, 5_000)) -> DataFrame:
    """``best``, the highest cosine of each row with another row of ``known`` in its group; null if there is none. A vector
    that is null, has nulls or another length counts as one without length: its cosine is 0.

    Every row is compared with all of its group's ``known``. Both are dealt over blocks, so that a task has a ``tile`` of
    about so many rows and known rows at most as two matrices, however large a group is."""
    parts = [max(1, -(-x.count() // n)) for x, n in zip((rows, known), tile, strict=True)]
    kind = rows.schema[id_].dataType.simpleString()
    keys = [group, "_r", "_k"]

    def dealt(table: DataFrame, own: str, other: str, n: int, m: int) -> DataFrame:
        whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector).cast("array<double>")).alias("_v")
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return table.dropna(subset=[group, id_]).select(group, id_, whole, F.pmod(F.xxhash64(id_), F.lit(n)).cast("int").alias(own), every)

    def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.stack(vectors).astype(float)
        return own, np.sqrt((own * own).sum(axis=1))

    def best(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        ids, others = ours[id_].to_numpy(), theirs[id_].to_numpy()
        width, wide = (np.array([-1 if v is None else len(v) for v in t["_v"]], np.int64) for t in (ours, theirs))
        top = np.full(len(ids), -np.inf)
        for w in np.unique(width) if len(others) else ():
            mine, same = np.flatnonzero(width == w), np.flatnonzero((wide == w) & (w > 0))
            bank, far = unit(theirs["_v"].to_numpy()[same]) if len(same) else (None, None)
            for k in range(0, len(mine), 1000):
                at = mine[k : k + 1000]
                cosines = np.zeros((len(at), len(others)))
                if bank is not None:
                    own, near = unit(ours["_v"].to_numpy()[at])
                    length = near[:, None] * far[None]
                    cosines[:, same] = np.divide(own @ bank.T, length, out=np.zeros_like(length), where=(length > 0) | np.isnan(length))
                cosines[ids[at][:, None] == others[None]] = -np.inf
                top[at] = cosines.max(axis=1)
        met = top > -np.inf
        met |= np.isnan(top)
        return pd.DataFrame({id_: ids[met], "best": top[met]})

    pairs = dealt(rows, "_r", "_k", *parts).groupBy(*keys).cogroup(dealt(known, "_k", "_r", *parts[::-1]).groupBy(*keys))
    found = pairs.applyInPandas(best, f"{id_} {kind}, best double").groupBy(id_).agg(F.max("best").alias("best"))
    return rows.select(id_).join(found, id_, "left")


def with_nested(jobs: DataFrame, parts: DataFrame, key: str, columns: list[str], done: str) -> DataFrame:
    """Each job with its ``parts`` as an array of structs (sorted; empty if there is none), and ``done``, the latest of theirs.
    A job's parts meet in one array."""
    per = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("parts"), F.max(done).alias("done"))
    kind = per.schema["parts"].dataType.simpleString()
    return jobs.join(per, key, "left").withColumn("parts", F.coalesce("parts", F.expr("array()").cast(kind)))


def held(rows: DataFrame, keys: list[str], order: list[str], value: Column, frames: int) -> Column:
    """The last value that is not null within the row and the ``frames`` before it in its key."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-frames, 0))


def review_grid(files: DataFrame, id_: str, start: str, offsets: list[float], bonus: DataFrame) -> DataFrame:
    """Instants to review: ``id_``, at_s, kind. Each file at the fixed offsets from its ``start``, and the instants of
    ``bonus`` (``id_``, at_s); equal ones count once, as bonus."""
    fixed = files.select(id_, F.explode(F.array(*[F.col(start) + F.lit(float(o)) for o in offsets])).alias("at_s"), F.lit("fixed").alias("kind"))
    return fixed.unionByName(bonus.select(id_, "at_s", F.lit("bonus").alias("kind"))).groupBy(id_, "at_s").agg(F.min("kind").alias("kind"))


def compact_span(rows: DataFrame, keys: list[str], ts: str, box: Column, window: float) -> Column:
    """The diagonal of the extent of a key's centres within the last ``window`` of its clock."""
    w = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-window, 0)
    width = lambda c: F.max(c).over(w) - F.min(c).over(w)
    return F.sqrt(F.pow(width(G.centre_x(box)), 2) + F.pow(width(G.centre_y(box)), 2))


def latest_visitor(places: DataFrame, trail: DataFrame, key: str, id_: str, visitor: str, tie: str, window: float, margin: float) -> DataFrame:
    """The visitor that was last at each place in the ``window`` seconds before it: ``id_``, ``actor``, ``steps`` (how many
    points of all trails lay there).

    places: ``key``, ``id_``, at (the instant), x0, y0, x1, y1; trail: ``key``, ``visitor``, ``tie``, ts_s, x, y in the same
    units. A point counts within ``margin`` of the box. Places are listed under the two slots of time that their window
    touches, so both meet by key and slot, which a task has as arrays. Points at one spot are sorted by time once: what a
    spot adds to a place is found by two searches, so no pair of a place and a point is listed.
    """
    slot = lambda c: F.floor(F.col(c) / window)
    low, high = (lambda c: F.col(c) - margin), (lambda c: F.col(c) + margin)
    listed = places.select(key, F.explode(F.array(slot("at"), slot("at") - 1)).alias("_slot"), id_, "at", low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1")).dropna()
    points = trail.select(key, slot("ts_s").alias("_slot"), visitor, tie, "ts_s", "x", "y").dropna(subset=[key, "ts_s", "x", "y"])
    kind = {f.name: f.dataType.simpleString() for f in [*places.schema, *trail.schema]}

    def met(places: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["x", "y", "ts_s", tie], kind="stable")
        x, y, t, rank = (points[c].to_numpy() for c in ("x", "y", "ts_s", tie))
        starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)])
        places = places.sort_values("x0", kind="stable")
        x0, y0, x1, y1, at = (places[c].to_numpy() for c in ("x0", "y0", "x1", "y1", "at"))
        steps, last = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(x)][: len(starts)], strict=True):
            some = np.flatnonzero((x1[: (n := np.searchsorted(x0, x[i], "right"))] >= x[i]) & (y0[:n] <= y[i]) & (y1[:n] >= y[i]))
            first, end = np.searchsorted(t[i:j], at[some] - window), np.searchsorted(t[i:j], at[some])
            steps[some] += np.maximum(end - first, 0)
            some, end = some[end > first], end[end > first] + i - 1
            old = last[some]
            later = (old < 0) | (t[end] > t[old]) | ((t[end] == t[old]) & (rank[end] > rank[old]))
            last[some[later]] = end[later]
        hit = last >= 0
        at_ = last[hit]
        return pd.DataFrame({id_: places[id_].to_numpy()[hit], "ts_s": t[at_], "tie": rank[at_], "actor": points[visitor].to_numpy()[at_], "steps": steps[hit]})

    found = listed.groupBy(key, "_slot").cogroup(points.groupBy(key, "_slot")).applyInPandas(met, f"{id_} {kind[id_]}, ts_s double, tie {kind[tie]}, actor {kind[visitor]}, steps long")
    return found.groupBy(id_).agg(F.max_by("actor", F.struct("ts_s", "tie")).alias("actor"), F.sum("steps").alias("steps"))
