"""Operators within one frame: greedy suppression as a fold over an array, without Python, and one-to-one matching.

A frame's boxes fit in one array there, so a frame is one row of one aggregation; frames run in parallel. Matching joins a
frame's boxes to pairs and takes them in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynxframe.functions import geometry as G


def suppress(boxes: DataFrame, frame: str, least_iou: float, same_class: bool = False, conflict=None, last: Column | None = None, limit: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Greedy non-maximum suppression per frame: boxes by falling confidence, then det_id; one is kept unless a kept one
    (of its class, if ``same_class``) overlaps it by ``least_iou`` or more. ``conflict`` replaces that test. Boxes for
    which ``last`` holds rank after all others; ``limit`` keeps so many of a frame; columns ``more`` come along. A frame's boxes meet in one array.
    """
    test = conflict or (lambda k, b: G.iou(k.box, b.box) >= least_iou)

    def clash(k: Column, b: Column) -> Column:
        return test(k, b) & (k.class_id == b.class_id) if same_class else test(k, b)

    late = F.lit(False) if last is None else last
    order = F.struct(late.alias("late"), (-F.col("conf")).alias("rank"), "det_id", "class_id", "conf", F.struct("x0", "y0", "x1", "y1").alias("box"), *more)
    rows = boxes.groupBy(frame).agg(F.array_sort(F.collect_list(order)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: clash(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    if limit:
        kept = F.slice(kept, 1, limit)
    return rows.select(frame, F.explode(kept).alias("k")).select(frame, "k.det_id", "k.class_id", "k.conf", "k.box.*", *[f"k.{c}" for c in more])


def edges(left: DataFrame, right: DataFrame, frame: str, least_iou: float = 0.3, edge=None, how: str = "inner", more: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())) -> DataFrame:
    """A row per pair of a frame that may match: frame, k0, k1, ... (what pairs are taken by), det_id, gt_id, iou and the
    columns ``more`` of either side. ``how``: ``full`` adds the rows of either side that no other may match, with nulls."""
    rule = edge or (lambda x, y: (G.iou(x.box, y.box) >= least_iou, [-G.iou(x.box, y.box), -x.conf]))
    sides = ("x0", "y0", "x1", "y1")
    flat = lambda rows, to, own: rows.select(*[F.col(c).alias(f"{to}{c}") for c in (frame, *own, *sides)])
    whole = lambda to, own: F.struct(*[F.col(f"{to}{c}").alias(c) for c in own], F.struct(*[F.col(f"{to}{s}").alias(s) for s in sides]).alias("box"))
    x, y = whole("_l_", ("det_id", "conf")), whole("_r_", ("gt_id",))
    test, ranks = rule(x, y)
    both = flat(left, "_l_", dict.fromkeys(("det_id", "conf", *more[0]))).join(flat(right, "_r_", dict.fromkeys(("gt_id", *more[1]))), (F.col(f"_l_{frame}") == F.col(f"_r_{frame}")) & test, how)
    of = lambda to, names: [F.col(f"{to}{c}").alias(c) for c in names]
    met = F.col("_l_det_id").isNotNull() & F.col("_r_gt_id").isNotNull()
    return both.select(F.coalesce(f"_l_{frame}", f"_r_{frame}").alias(frame), *[k.alias(f"k{i}") for i, k in enumerate(ranks)], *of("_l_", ("det_id",)), *of("_r_", ("gt_id",)), F.when(met, G.iou(x.box, y.box)).alias("iou"), *of("_l_", more[0]), *of("_r_", more[1]))


def best_first(pairs: DataFrame, keys: list[str], rest: bool = False) -> DataFrame:
    """Of the rows of ``edges``, those that are taken one to one within ``keys``, best first, with ``side`` both; if ``rest``, also
    a row for each id that found no partner (left, right). Rows of a key come in order, and a task holds the ids of one key."""
    ranks = [c for c in pairs.columns if c[0] == "k" and c[1:].isdigit()]
    kept = [c for c in pairs.columns if c not in ranks]
    ordered = pairs.repartition(*keys).sortWithinPartitions(*keys, *ranks, "det_id", "gt_id").select(*kept)
    schema = T.StructType([*ordered.schema.fields, T.StructField("side", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, dets, gts = None, {}, {}

        def alone() -> list[tuple]:
            return [(*key, d, None, "left") for d, done in dets.items() if not done] + [(*key, None, g, "right") for g, done in gts.items() if not done]

        def made(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
            columns = dict(zip([*keys, "det_id", "gt_id", "side"], zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in types], schema=types)

        types = None
        for batch in batches:
            types = pa.schema([*[pa.field(f.name, f.type) for f in batch.schema], pa.field("side", pa.string())])
            taken, left = [], []
            owners = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for n, (own, d, g) in enumerate(zip(owners, batch.column("det_id").to_pylist(), batch.column("gt_id").to_pylist(), strict=True)):
                if own != key:
                    left += alone() if rest and key is not None else []
                    key, dets, gts = own, {}, {}
                free = d is not None and g is not None and not dets.get(d) and not gts.get(g)
                if free:
                    taken.append(n)
                if d is not None:
                    dets[d] = free or dets.get(d, False)
                if g is not None:
                    gts[g] = free or gts.get(g, False)
            found = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(["both"] * len(taken), pa.string())], schema=types)
            if left:
                yield made(left, types)
        if rest and key is not None and (left := alone()):
            yield made(left, types)

    return ordered.mapInArrow(run, schema)


def associate(left: DataFrame, right: DataFrame, frame: str, least_iou: float = 0.3, edge=None) -> DataFrame:
    """One-to-one pairs per frame, best first, with the rows of either side that found no partner.

    left: frame, det_id, conf and a box; right: frame, gt_id and a box; ids are unique in a frame. Pairs are taken by IoU,
    then confidence, then ids. ``edge(x, y)`` of two structs with ``box`` may replace that by (condition, columns to sort
    by). What may pair is an equi-join on the frame, so no row holds a frame. Returns frame, det_id, gt_id, iou, side (both,
    left, right).
    """
    return best_first(edges(left, right, frame, least_iou, edge, "full"), [frame], rest=True)


def match(left: DataFrame, right: DataFrame, frame: str, least_iou: float) -> DataFrame:
    """The pairs of ``associate``: frame, det_id, gt_id, iou."""
    return associate(left, right, frame, least_iou).where("side = 'both'").drop("side")


def merge_labels(boxes: DataFrame, frame: str, least_iou: float) -> DataFrame:
    """Boxes of a frame that overlap by ``least_iou`` or more are one label: by det_id, each joins the first label whose
    box it overlaps, or begins one. Returns frame, det_id (the first), ids (all, in order) and the first one's box."""
    row = F.struct("det_id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    rows = boxes.groupBy(frame).agg(F.array_sort(F.collect_list(row)).alias("all"))
    seed = F.transform("all", lambda b: F.struct(b.det_id.alias("det_id"), b.box.alias("box"), F.array(b.det_id).alias("ids")))

    def add(kept: Column, b: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: G.iou(k.box, b.box) >= least_iou), True)
        joined = F.transform(kept, lambda k, i: F.struct(k.det_id.alias("det_id"), k.box.alias("box"), F.when(i + 1 == at, F.concat(k.ids, b.ids)).otherwise(k.ids).alias("ids")))
        return F.when(at > 0, joined).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate(seed, F.slice(seed, 1, 0), add)
    return rows.select(frame, F.explode(kept).alias("k")).select(frame, "k.det_id", "k.ids", "k.box.*")


def uncovered(boxes: DataFrame, others: DataFrame, frame: str, test) -> DataFrame:
    """Boxes for which no box of ``others`` in their frame passes ``test(box, other)``."""
    b = others.select(F.col(frame).alias("_frame"), F.struct("x0", "y0", "x1", "y1").alias("_other"))
    hit = (F.col(frame) == F.col("_frame")) & test(F.struct("x0", "y0", "x1", "y1"), F.col("_other"))
    return boxes.join(b, hit, "left_anti")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piles(boxes: DataFrame, frame: str, most_gap: float, least: int, pad: float = 0.0, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """Boxes of a frame that lie at most ``most_gap`` apart are one pile, and so are piles whose union boxes do, until no
    two are that near: frame, det_id (the smallest), n, conf (the highest) and the union box, padded within the canvas.

    Piles of fewer than ``least`` boxes go. What is merged does not depend on the order: unions only grow nearer. A frame's
    boxes meet in one array, and each is added to the piles so far in a fold, without Python. Boxes with a null side count
    as no box.
    """
    sides = ("x0", "y0", "x1", "y1")
    one = F.struct("det_id", F.lit(1).alias("n"), "conf", *sides)
    rows = boxes.dropna(subset=list(sides)).groupBy(frame).agg(F.array_sort(F.collect_list(one)).alias("all"))

    def union(a: Column, b: Column, n: Column) -> Column:
        low, high = (lambda s: F.least(a[s], b[s]).alias(s)), (lambda s: F.greatest(a[s], b[s]).alias(s))
        return F.struct(F.least(a.det_id, b.det_id).alias("det_id"), n.alias("n"), F.greatest(a.conf, b.conf).alias("conf"), low("x0"), low("y0"), high("x1"), high("y1"))

    def add(kept: Column, b: Column) -> Column:
        # As many passes as there are piles: each takes in at least one more, or none will be.
        near = lambda g: F.aggregate(kept, g, lambda u, k: F.when(G.gap(u, k) <= most_gap, union(u, k, u.n)).otherwise(u))
        grown = F.aggregate(kept, b, lambda g, _: near(g))

        def placed(g: Column) -> Column:
            taken = F.aggregate(F.filter(kept, lambda k: G.gap(g, k) <= most_gap), F.lit(1), lambda n, k: n + k.n)
            return F.concat(F.filter(kept, lambda k: G.gap(g, k) > most_gap), F.array(F.struct(g.det_id.alias("det_id"), taken.alias("n"), g.conf.alias("conf"), *[g[s].alias(s) for s in sides])))

        return let(grown, placed)

    found = rows.select(frame, F.explode(F.aggregate("all", F.slice("all", 1, 0), add)).alias("p")).where(F.col("p.n") >= least)
    padded = [F.greatest(F.col(f"p.{s}") - pad, F.lit(0.0)).alias(s) for s in sides[:2]] + [F.least(F.col(f"p.{s}") + pad, F.lit(float(m))).alias(s) for s, m in zip(sides[2:], (width, height), strict=True)]
    return found.select(frame, "p.det_id", "p.n", "p.conf", *padded)
