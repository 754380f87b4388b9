"""Rules over observations and recordings: motion, windows of evidence, grids of instants, conflicts, picks, intervals, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.functions import rules as R
from lynxframe.operators import blocks, joins, timeline
from lynxframe.operators.selection import stable_rank


def time_to_edge(rows: DataFrame, keys: list[str], order: list[str], box: Column, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """``rows`` with ``edge_s``: when the box leaves the canvas if it goes on as from its last row to this one; null for one
    that stands still. Rows at which the clock (the first of ``order``) does not rise are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = lambda c: c - F.lag(c).over(w)
    moved = rows.withColumn("_b", box).withColumn("_dt", step(F.col(order[0]))).withColumn("_dx", step(G.centre_x(F.col("_b")))).withColumn("_dy", step(G.centre_y(F.col("_b")))).where("_dt > 0")
    to = lambda low, high, d, most: F.when(F.col(d) < 0, low / (-F.col(d) / F.col("_dt"))).when(F.col(d) > 0, (most - high) / (F.col(d) / F.col("_dt")))
    b = F.col("_b")
    return moved.withColumn("edge_s", F.least(to(b.x0, b.x1, "_dx", width), to(b.y0, b.y1, "_dy", height))).drop("_b", "_dt", "_dx", "_dy")


def projected(keys: list[str], order: list[str], value: str, most_age: float) -> Column:
    """``value`` carried on to a row from the two rows before it in its key at constant speed; null if they are not two
    instants or the last one is older than ``most_age``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    t, t0, t1 = F.col(order[0]), F.lag(order[0], 1).over(w), F.lag(order[0], 2).over(w)
    v0, v1 = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return F.when((t - t0 <= most_age) & (t0 > t1), v0 + (v0 - v1) / (t0 - t1) * (t - t0))


def confirm_window(rows: DataFrame, keys: list[str], order: list[str], hit: Column, n: int, least_hits: int, least_span: float, least_share: float) -> DataFrame:
    """``rows`` with ``hits`` in their last ``n`` and ``reasons`` (joined by a comma) why these do not confirm: few hits, too
    short, low share; none if they do."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    seen = rows.withColumn("hits", F.sum(hit.cast("int")).over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_span", F.col(order[0]) - F.min(order[0]).over(w))
    reasons = [F.when(F.col("hits") < least_hits, "few hits"), F.when(F.col("_span") < least_span, "too short"), F.when(F.col("hits") < least_share * F.col("_n"), "low share")]
    return seen.withColumn("reasons", F.concat_ws(",", *reasons)).drop("_n", "_span")


def transitions(rows: DataFrame, keys: list[str], order: list[str], state: str, forbidden: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows at which ``state`` is another than in the row before of the key, with that as ``before``; only the ``forbidden``
    pairs (before, state) if they are given."""
    changed = rows.withColumn("before", F.lag(state).over(Window.partitionBy(*keys).orderBy(*order)))
    if forbidden is None:
        return changed.where(F.col("before") != F.col(state))
    bad = F.lit(False)
    for a, b in forbidden:
        bad = bad | ((F.col("before") == a) & (F.col(state) == b))
    return changed.where(bad)


def interval_grid(rows: DataFrame, start: str, end: str, step: int, most: int = 10_000) -> DataFrame:
    """``rows`` with ``at_s``: the instants from ``start`` on, every ``step`` seconds before ``end``, at most ``most`` a row."""
    first = F.col(start).cast("long")
    last = F.least(F.col(end).cast("long") - 1, first + (most - 1) * step)
    return rows.withColumn("at_s", F.explode(F.when(last >= first, F.sequence(first, last, F.lit(step).cast("long")))))


def seeded_offsets(rows: DataFrame, id_: str, start: str, fixed: list[int], span: int, salt: str) -> DataFrame:
    """``rows`` with ``offset_no`` and ``at_s``: instants at the fixed offsets from ``start``, and one drawn from ``span``
    seconds by a hash of the id, always the same."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), F.col(id_).cast("string"))), 1, 8), 16, 10).cast("long") % span
    offsets = F.array(*[F.lit(o).cast("long") for o in fixed], drawn)
    return rows.select("*", F.posexplode(offsets).alias("offset_no", "_o")).withColumn("at_s", (F.col(start) + F.col("_o")).cast("long")).drop("_o")


def visible_seconds(rows: DataFrame, keys: list[str], ts: str, period: int) -> DataFrame:
    """``visible_s`` of each key: its distinct ticks times their period."""
    return rows.groupBy(*keys).agg((F.countDistinct(F.floor(F.col(ts) / period)) * period).alias("visible_s"))


def crop_results(priors: DataFrame, found: DataFrame, frame: str, id_: str, least_iou: float) -> tuple[DataFrame, DataFrame]:
    """What was found in the crop of each prior (frame, ``id_``, box ``p``) among ``found`` (frame, box ``d``, others): the
    rows that match it by ``least_iou``, and for each prior ``results`` and ``matched``. A find that matches no prior proves
    nothing, as a crop is no fair sample of the scene."""
    met = priors.join(found.withColumn("_there", F.lit(1)), frame, "left").withColumn("_ok", G.iou(F.col("p"), F.col("d")) >= least_iou)
    counts = met.groupBy(id_).agg(F.count("_there").alias("results"), F.count_if("_ok").alias("matched"))
    return met.where("_ok").drop("_ok", "_there"), counts


def polarity_conflicts(rows: DataFrame, content: list[str], label: str) -> DataFrame:
    """``positives``, ``negatives`` and ``conflict`` (both occur) of each content, as a hash or a place."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.groupBy(*content).agg(pos.alias("positives"), neg.alias("negatives")).withColumn("conflict", (F.col("positives") > 0) & (F.col("negatives") > 0))


def near_required(rows: DataFrame, known: DataFrame, key: str, id_: str, side: float, window: float, same: float) -> DataFrame:
    """Rows (key, ``id_``, ts_s, box) that overlap a required box (key, t, box) within ``window`` seconds: ``verdict``
    (exclude if one is within ``same``, as it shows the same frame; else warn) and ``required``, how many."""
    slot = lambda c: F.floor(F.col(c) / window)
    listed = known.withColumn("_slot", F.explode(F.sequence(slot("t") - 1, slot("t") + 1)))
    met = joins.touching_boxes(rows.withColumn("_slot", slot("ts_s")), listed, [key, "_slot"], side, lambda a, b: G.overlap(a, b) > 0)
    close = met.withColumn("_gap", F.abs(F.col("ts_s") - F.col("t"))).where(F.col("_gap") <= window)
    return close.groupBy(id_).agg(F.when(F.count_if(F.col("_gap") <= same) > 0, "exclude").otherwise("warn").alias("verdict"), F.count("*").alias("required"))


def seen_places(rows: DataFrame, known: DataFrame, key: str, id_: str, known_id: str, reach: float) -> DataFrame:
    """``id_`` and ``seen_before``: whether a known place (key, ``known_id``, box) other than the row itself lies within ``reach``."""
    # Equal boxes are one place. Of the ids near a row the smallest or the largest is not its own if there is any other.
    places = known.groupBy(key, "box").agg(F.min(known_id).alias("_low"), F.max(known_id).alias("_high"))
    near = joins.near_boxes(rows.select(key, "box").distinct(), places, [key], reach, lambda a, b: G.distance(a, b) <= reach)
    near = near.groupBy(key, "box").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    hits = rows.join(near, [key, "box"]).where((F.col(id_) != F.col("_low")) | (F.col(id_) != F.col("_high"))).select(id_).distinct()
    return rows.select(id_).join(hits.withColumn("_hit", F.lit(True)), id_, "left").select(id_, F.coalesce("_hit", F.lit(False)).alias("seen_before"))


def blind_choice(rows: DataFrame, key: str, cells: list[str], id_: str, at_random: int) -> DataFrame:
    """``key``, ``id_``, ``how``: so many rows of each key at random (by a hash), and of the others one from each cell."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(stable_rank("blind", F.col(id_)))))
    cover = F.row_number().over(Window.partitionBy(key, *cells).orderBy(stable_rank("cover", F.col(id_))))
    rest = ranked.where(F.col("_k") > at_random).withColumn("_n", cover).where("_n = 1")
    return ranked.where(F.col("_k") <= at_random).select(key, id_, F.lit("random").alias("how")).unionByName(rest.select(key, id_, F.lit("coverage").alias("how")))


def top_priors(rows: DataFrame, events: DataFrame, frame: str, id_: str, score: str, k: int) -> DataFrame:
    """The ``k`` best rows (frame, ``id_``, ``score``, box) of each frame: those whose centre lies in no event (frame, box)
    first, then by score: frame, ``id_``, attached, place. A frame's events meet in one array."""
    held = events.groupBy(frame).agg(F.collect_list("box").alias("_events"))
    b = F.col("box")
    attached = F.coalesce(F.exists("_events", lambda t: G.contains(t, G.centre_x(b), G.centre_y(b))), F.lit(False))
    place = F.row_number().over(Window.partitionBy(frame).orderBy("attached", F.desc(score), id_)).cast("long")
    return rows.join(held, frame, "left").withColumn("attached", attached).withColumn("place", place).where(F.col("place") <= k).select(frame, id_, "attached", "place")


def grid_proposals(keys: DataFrame, key: str, columns: int, rows: int, region: Column, n: int, salt: str = "grid") -> DataFrame:
    """``n`` cells of a grid whose centres lie in the polygon ``region``, for each key by a hash: key, x, y, place."""
    count = lambda k: F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    cells = keys.select(key).distinct().select(key, F.explode(count(columns)).alias("x")).select("*", F.explode(count(rows)).alias("y"))
    inside = cells.where(G.in_polygon(F.col("x") + 0.5, F.col("y") + 0.5, region))
    place = F.row_number().over(Window.partitionBy(key).orderBy(stable_rank(salt, F.col(key), F.col("x"), F.col("y"))))
    return inside.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def interval_faults(rows: DataFrame, key: str, id_: str, start: str, end: str) -> DataFrame:
    """``id_``, ``key``, ``violation``: intervals that are empty, overlap an earlier one of their key or repeat an id."""
    before = Window.partitionBy(key).orderBy(start, id_).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_upto", F.max(end).over(before)).withColumn("_same", F.count("*").over(Window.partitionBy(id_)))
    found = F.array_compact(F.array(F.when(F.col(end) <= F.col(start), "empty interval"), F.when(F.col(start) < F.col("_upto"), "overlaps an earlier one"), F.when(F.col("_same") > 1, "repeated id")))
    return marked.select(id_, key, F.explode(found).alias("violation"))


def class_labels(rows: DataFrame, names: DataFrame, class_id: str, name: str) -> DataFrame:
    """``rows`` with ``label``: the class's name, or ``class-`` and its number where it has none."""
    known = names.select(F.col(class_id), F.col(name).alias("_name"))
    return rows.join(known, class_id, "left").withColumn("label", F.coalesce("_name", F.concat(F.lit("class-"), F.col(class_id).cast("string")))).drop("_name")


def parsed_time(text: Column, formats: list[str], zone: str | None = None) -> Column:
    """The instant that a text names in the first of the formats that fits, in the clock of ``zone`` (null: the session's);
    null if none does."""
    at = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return at if zone is None else F.to_utc_timestamp(at, zone)


def copy_reason(keys: list[str], order: list[str], state: str, most_gap: float) -> Column:
    """Whether a label may be taken over from the row before: ``first`` (there is none), ``same kind``, ``close`` in time, or ``no``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col(order[0]) - F.lag(order[0]).over(w)
    return F.when(gap.isNull(), "first").when(F.lag(state).over(w) == F.col(state), "same kind").when(gap <= most_gap, "close").otherwise("no")


def frame_faults(cells: DataFrame, frame: str, value: str, least_contrast: float, bright: float, dark: float) -> DataFrame:
    """``faults`` (joined by a comma: low contrast, bright, dark) and ``usable`` of each frame, from its cells' values: their
    range, and the share of positive ones."""
    out = cells.groupBy(frame).agg((F.max(value) - F.min(value)).alias("_range"), (F.count_if(F.col(value) > 0) / F.count("*")).alias("_share"))
    found = R.reasons((F.col("_range") < least_contrast, "low contrast"), (F.col("_share") > bright, "bright"), (F.col("_share") < dark, "dark"))
    return out.select(frame, F.array_join(found, ",").alias("faults"), (F.size(found) == 0).alias("usable"))


def cell_tolerances(cells: DataFrame, keys: list[str], value: str, base: float, k: float, floor: float, cap: float) -> DataFrame:
    """``tolerance`` of each cell, min(max(base, |median| + max(k MAD, floor)), cap), and ``biased``, whether the cap cut it. A
    cell may have any number of values."""
    mid = blocks.exact_median(cells.select(*keys, value), keys, value, "_mid")
    mad = blocks.exact_median(cells.join(mid, keys).withColumn("_off", F.abs(F.col(value) - F.col("_mid"))), keys, "_off", "_mad")
    raw = F.abs("_mid") + F.greatest(k * F.col("_mad"), F.lit(floor))
    return mid.join(mad, keys).select(*keys, F.least(F.greatest(F.lit(base), raw), F.lit(cap)).alias("tolerance"), (raw > cap).alias("biased"))


def policies_compared(rows: DataFrame, groups: list[str], first: Column, second: Column, positive: Column) -> DataFrame:
    """Two selections over the same frames: ``frames``, ``first_kept``, ``second_kept``, ``both_kept`` and ``gain``, how many
    more positives the first one keeps."""
    return rows.groupBy(*groups).agg(F.count("*").alias("frames"), F.count_if(first).alias("first_kept"), F.count_if(second).alias("second_kept"), F.count_if(first & second).alias("both_kept"), (F.count_if(positive & first) - F.count_if(positive & second)).alias("gain"))


def sightings(visible: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """For each visible interval [start_s, end_s) of the keys: ``sightings``, the rows of ``seen`` (keys, ts_s) in it, and
    ``delay_s`` from its start to the first of them."""
    inside = (F.col("ts_s") >= F.col("start_s")) & (F.col("ts_s") < F.col("end_s"))
    met = visible.join(seen.select(*keys, "ts_s"), keys, "left").withColumn("_hit", F.when(inside, F.col("ts_s")))
    return met.groupBy(*keys, "start_s", "end_s").agg(F.count("_hit").alias("sightings"), (F.min("_hit") - F.col("start_s")).alias("delay_s"))


def live_counters(rows: DataFrame, key: str, order: list[str], corrupt: Column, long_gap: float) -> DataFrame:
    """``frames``, ``corrupt``, ``long_gaps`` and ``max_gap_s`` of each stream; a stream may have any number of rows."""
    stepped = blocks.previous(rows.withColumn("_bad", corrupt), [key], order, [order[0]])
    gap = F.col(order[0]) - F.col(f"prev1_{order[0]}")
    return stepped.groupBy(key).agg(F.count("*").alias("frames"), F.count_if("_bad").alias("corrupt"), F.count_if(gap > long_gap).alias("long_gaps"), F.max(gap).alias("max_gap_s"))


def burst_cap(rows: DataFrame, key: str, ts: str, id_: str, place: list[str], score: str, slot: float, period: float, most: int) -> DataFrame:
    """Rounds of one row a key and ``period``, best score first, at most ``most``: rows at one place in one ``slot`` of time
    count once, the first. Adds ``slot``, ``period`` (their numbers) and ``round``."""
    cut = rows.withColumn("slot", F.floor(F.col(ts) / slot)).withColumn("period", F.floor(F.col(ts) / period))
    once = timeline.latest(cut, [key, "slot", *place], [F.col(ts), F.col(id_)])
    w = Window.partitionBy(key, "period").orderBy(F.desc(score), id_)
    return once.withColumn("round", F.row_number().over(w).cast("long")).where(F.col("round") <= most)


def time_part(start: str, end: str, parts: list[tuple[str, float, float]], other: str) -> Column:
    """The first part (name, from, to) that holds a whole interval, or ``other`` if it crosses their bounds."""
    return R.chain(*[((F.col(start) >= low) & (F.col(end) <= high), name) for name, low, high in parts], other=other)
