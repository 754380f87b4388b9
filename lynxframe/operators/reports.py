"""Reports over scored, reviewed or measured rows: groups, histograms, percentiles against limits, envelopes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxframe.operators import blocks, frames


def quality_by_threshold(boxes: DataFrame, truth: DataFrame, frame: str, thresholds: list[float], size: Column) -> DataFrame:
    """Matches, misses and false boxes at every threshold and size band of the truth (false boxes: of their own).

    ``size`` names the band of a row with columns x0, y0, x1, y1. A box counts at all thresholds up to its confidence; ids
    are unique in a frame, so false boxes are all boxes less those that are taken.
    """
    steps = F.array(*[F.lit(t) for t in thresholds])
    sized, wanted = boxes.withColumn("_band", size), truth.withColumn("_wanted", size)
    # What may pair is the same at all thresholds, so it is joined once; pairs are taken at each.
    pairs = frames.edges(sized, wanted, frame, more=(("conf", "_band"), ("_wanted",)))
    found = frames.best_first(pairs.select("*", F.explode(steps).alias("threshold")).where("conf >= threshold").drop("conf"), [frame, "threshold"])
    found = found.groupBy("threshold", "_band", "_wanted").agg(F.count("*").alias("n"))
    each = sized.groupBy(F.col("_band").alias("size"), *[(F.col("conf") >= t).alias(f"_at{i}") for i, t in enumerate(thresholds)]).agg(F.count("*").alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_at{i}").alias("passes")) for i, t in enumerate(thresholds)])).alias("t")
    each = each.select("size", "n", at).where("t.passes").select("t.threshold", "size", "n")
    required = wanted.groupBy(F.col("_wanted").alias("size")).agg(F.count("*").alias("n")).select(F.explode(steps).alias("threshold"), "size", F.col("n").alias("required"))
    zero = F.lit(0).cast("long")
    counts = [
        required.select("threshold", "size", "required", zero.alias("hit"), zero.alias("fp")),
        found.select("threshold", F.col("_wanted").alias("size"), zero.alias("required"), F.col("n").alias("hit"), zero.alias("fp")),
        found.select("threshold", F.col("_band").alias("size"), zero.alias("required"), zero.alias("hit"), (-F.col("n")).alias("fp")),
        each.select("threshold", "size", zero.alias("required"), zero.alias("hit"), F.col("n").alias("fp")),
    ]
    out = functools.reduce(DataFrame.unionByName, counts).groupBy("threshold", "size").agg(*[F.sum(c).alias(c) for c in ("required", "hit", "fp")])
    return out.where("required > 0 or fp > 0")


def percentiles_within(rows: DataFrame, key: str, value: str, share: float, limits: DataFrame, least: int) -> DataFrame:
    """Nearest-rank percentile of every key against its limit: pass, fail, or insufficient below ``least`` rows."""
    placed = blocks.numbered(rows.where(F.col(value).isNotNull()).select(key, value), [key], [F.col(value)])
    at = placed.where(F.col("place") == F.greatest(F.ceil(F.col("of") * share), F.lit(1))).select(key, F.col(value).alias("percentile"), "of")
    verdict = F.when(F.coalesce("of", F.lit(0)) < least, "insufficient").when(F.col("percentile") <= F.col("limit"), "pass").otherwise("fail")
    return limits.join(at, key, "left").select(key, F.coalesce("of", F.lit(0)).alias("n"), "percentile", verdict.alias("verdict"))


def envelope(rows: DataFrame, keys: list[str], value: str, share: float, margin: float, least: int, fallback: float) -> DataFrame:
    """A limit per key: its ``share`` quantile plus ``margin``; the fallback below ``least`` values."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.lit(share)).alias("q"))
    return out.select(*keys, "n", F.when(F.col("n") < least, fallback).otherwise(F.col("q") + margin).alias("limit"))


def size_prior(rows: DataFrame, keys: list[str], least: int, fallback: tuple[float, float]) -> DataFrame:
    """Median width and height per key, the fallback below ``least`` rows, and on how many rows they rest."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(F.col("x1") - F.col("x0"), F.lit(0.5)).alias("w"), F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).alias("h"))
    pick = lambda c, f: F.when(F.col("n") < least, f).otherwise(F.col(c))
    return out.select(*keys, "n", pick("w", fallback[0]).alias("width"), pick("h", fallback[1]).alias("height"))


def histograms(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts by each set of columns in one pass: ``n`` with the columns (null where not in the set) and which set it is."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def episodes(rows: DataFrame, key: str, id_: str, ts: str, required: Column) -> DataFrame:
    """A row per episode: first and last instant, members, distinct files and kinds, median box, and whether any member is
    required. The representative is the member nearest the middle of the time span (ties by id)."""
    span = rows.groupBy(key).agg(F.min(ts).alias("first_s"), F.max(ts).alias("last_s"))
    near = F.struct(F.abs(F.col(ts) - (F.col("first_s") + F.col("last_s")) / 2), F.col(id_))
    median = [F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in ("x0", "y0", "x1", "y1")]
    return rows.join(span, key).groupBy(key, "first_s", "last_s").agg(F.count("*").alias("members"), F.countDistinct("scene").alias("scenes"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.max(required).alias("required"), F.min_by(id_, near).alias("representative"), *median)


def isolated(cells: DataFrame, frame: str, columns: int) -> DataFrame:
    """Changed cells (``cell`` in a grid of ``columns``) with the number of changed ones around each (``around``)."""
    own = cells.select(frame, "cell", (F.col("cell") % columns).alias("_x"), F.floor(F.col("cell") / columns).alias("_y"))
    around = F.expr("explode(flatten(transform(sequence(-1, 1), i -> transform(filter(sequence(-1, 1), j -> not (i = 0 and j = 0)), j -> struct(_x + i as _x, _y + j as _y)))))")
    asked = own.select(frame, "cell", around.alias("_n")).select(frame, "cell", "_n.*")
    met = asked.join(own.select(frame, "_x", "_y", F.lit(1).alias("_hit")), [frame, "_x", "_y"])
    return own.select(frame, "cell").join(met.groupBy(frame, "cell").agg(F.count("*").alias("around")), [frame, "cell"], "left").na.fill(0, ["around"])


def phase_report(artifacts: dict[str, tuple[DataFrame, list[list[str]]]]) -> DataFrame:
    """Counts of several tables in one: ``artifact``, ``by`` (the columns of a set, comma-joined; '' for all rows), ``value``
    (their values, bar-joined, '-' for null), ``n``. One pass a table; counts are made before the shuffle."""
    out = None
    for name, (rows, sets) in artifacts.items():
        shown = lambda s: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in s]) if s else F.lit("")
        each = F.explode(F.array(*[F.struct(F.lit(",".join(s)).alias("by"), shown(s).alias("value")) for s in [[], *sets]])).alias("s")
        one = rows.select(each).groupBy(F.lit(name).alias("artifact"), "s.by", "s.value").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of doubles, with NaN for nulls and beyond a vector's end."""
    out = np.full((len(vectors), width), np.nan)
    for row, v in zip(out, vectors, strict=True):
        if v is not None:
            row[: min(len(v), width)] = [np.nan if x is None else x for x in v[:width]]
    return out


def nearest_references(rows: DataFrame, references: DataFrame, id_: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """The ``k`` nearest of ``references`` (``id_``, ``vector``) to each row, itself left out: ``id_``, reference, distance (the
    median absolute difference over the places that both have), place (from 1; ties: the smaller reference).

    References go to the tasks in blocks of about ``block``, as one array, and a task keeps the k best of each of its rows; so
    nothing is joined, and no more than k rows a block leave a task. Each block is one pass over ``rows``. Rows without a
    common place with a reference are not near it.
    """
    n = references.count()
    passes = -(-n // block)
    schema = f"{id_} {rows.schema[id_].dataType.simpleString()}, reference {references.schema[id_].dataType.simpleString()}, distance double"
    found = rows.sparkSession.createDataFrame([], schema)
    for number in range(passes):
        part = references.where(F.pmod(F.xxhash64(id_), F.lit(passes)) == number).select(id_, vector).orderBy(id_).collect()
        if not part:
            continue
        names = [r[0] for r in part]
        width = max(len(r[1] or []) for r in part)
        bank = _matrix([r[1] for r in part], width)

        def run(batches: Iterator[pa.RecordBatch], names=names, bank=bank, width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                vectors = batch.column(1).to_pylist()
                for at in range(0, len(ids), 64):
                    gaps = np.abs(_matrix(vectors[at : at + 64], width)[:, None, :] - bank[None])
                    whole = ~np.isnan(gaps).any()
                    there = np.ones(gaps.shape[:2], bool) if whole else ~np.isnan(gaps).all(axis=2)
                    far = np.median(gaps, axis=2) if whole else np.nanmedian(np.where(there[:, :, None], gaps, 0.0), axis=2)
                    for own, line, ok in zip(ids[at : at + 64], far, there, strict=True):
                        best = [j for j in np.argsort(line, kind="stable")[: k + 1 + int((~ok).sum())] if ok[j] and names[j] != own][:k]
                        out += [(own, names[j], float(line[j])) for j in best]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.float64()))], [id_, "reference", "distance"])

        found = found.unionByName(rows.select(id_, vector).mapInArrow(run, schema))
    best = found.groupBy(id_).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "reference"))), 1, k).alias("_b"))
    return best.select(id_, F.posexplode("_b").alias("_p", "_x")).select(id_, "_x.reference", "_x.distance", (F.col("_p") + 1).cast("long").alias("place"))
