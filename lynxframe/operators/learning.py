"""Linear heads on embeddings: features side by side, a weighted fit, scores, and scores by models that never saw the group."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxframe.functions.rules import dot
from lynxframe.shared import Scratch


class Head(NamedTuple):
    """A fitted head; as large as one vector."""

    weight: list[float]
    bias: float
    mean: list[float]
    std: list[float]


def features(tables: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """``key``, ``features``: the vectors of all tables (table, column) behind one another; keys that one lacks are left out."""
    out = None
    for i, (table, column) in enumerate(tables):
        one = table.select(key, F.col(column).alias(f"_f{i}"))
        out = one if out is None else out.join(one, key)
    return out.select(key, F.concat(*[f"_f{i}" for i in range(len(tables))]).alias("features"))


def unit(v: Column) -> Column:
    """The vector at length 1, as doubles; a zero vector stays."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-6))
    return F.transform(v, lambda x: x.cast("double") / length)


def linear_score(v: Column, *heads: Head) -> Column:
    """Mean over the heads of bias + weight . (unit(v) - mean) / max(std, 0.001)."""
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    total = F.lit(0.0)
    for h in heads:
        scale = [w / max(s, 1e-3) for w, s in zip(h.weight, h.std, strict=True)]
        total = total + h.bias + dot(F.zip_with(unit(v), lit(h.mean), lambda x, m: x - m), lit(scale))
    return total / len(heads)


def moments(rows: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each place of the unit vectors, in one pass; a row of two vectors reaches the driver."""
    at = rows.select(F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    found = sorted(at.collect())
    return [r.m for r in found], [r.s for r in found]


def fit(rows: DataFrame, vector: str, label: str, regularisation: float = 0.01, rounds: int = 30) -> Head:
    """A logistic head on standardised unit vectors; both classes have the same weight in all. Rows without a label are
    left out; one class alone is an error."""
    known = rows.where(F.col(label).isNotNull())
    mean, std = moments(known, vector)
    n = {r[0]: r[1] for r in known.groupBy(F.col(label).cast("int")).count().collect()}
    if set(n) != {0, 1}:
        raise ValueError(f"a head needs labels 0 and 1, found {sorted(n)}")
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    scaled = F.zip_with(F.zip_with(unit(F.col(vector)), lit(mean), lambda x, m: x - m), lit([max(s, 1e-3) for s in std]), lambda x, s: x / s)
    weight = F.when(F.col(label).cast("int") == 1, n[0] / n[1]).otherwise(1.0)
    ready = known.select(array_to_vector(scaled).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    model = LogisticRegression(weightCol="weight", regParam=regularisation, standardization=False, maxIter=rounds, tol=1e-4).fit(ready)
    return Head(model.coefficients.toArray().tolist(), float(model.intercept), mean, std)


def held_out(rows: DataFrame, vector: str, label: str, group: str, most_groups: int = 200) -> tuple[DataFrame, list[Head]]:
    """``rows`` with ``score`` by a head fitted on all other groups, and those heads. A fit each group, so more than
    ``most_groups`` is an error. Groups without a positive row, or whose rest lacks one, get no head and a null score."""
    known = Scratch(rows.sparkSession, "heads").save(rows.where(F.col(label).isNotNull()).select(group, label, vector))
    by = sorted(known.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("p")).limit(most_groups + 1).collect(), key=lambda r: str(r[0]))
    if len(by) > most_groups:
        raise ValueError(f"more than {most_groups} groups of {group}")
    total, score, heads = sum(r.p for r in by), F.lit(None).cast("double"), []
    for name, positive in by:
        if positive and positive < total:
            heads.append(fit(known.where(~F.col(group).eqNullSafe(F.lit(name))), vector, label))
            score = F.when(F.col(group).eqNullSafe(F.lit(name)), linear_score(F.col(vector), heads[-1])).otherwise(score)
    return rows.withColumn("score", score), heads
