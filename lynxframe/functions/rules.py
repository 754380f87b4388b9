"""Bands, classes and verdicts as Column expressions: each a chain of conditions, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Review floors and bands of source confidences.
REVIEW_FLOOR, LIKELY_FLOOR, WORKING_BAND = 0.15, 0.30, (0.10, 0.50)
#: What an identifier may hold.
IDENTIFIER = r"^[A-Za-z0-9_-]{1,64}$"


def chain(*rules: tuple[Column, str], other: str | None = None) -> Column:
    """The name of the first rule whose condition holds."""
    out = F
    for condition, name in rules:
        out = out.when(condition, name)
    return out.otherwise(other)


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of all rules whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))


def safe_identifier(text: Column, pattern: str = IDENTIFIER) -> Column:
    """Whether a text can be used as a name of a file or key; a null is none."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def actor_kind(class_id: Column, person: tuple[int, ...] = (0,), vehicle: tuple[int, ...] = (1, 2, 3, 5, 7)) -> Column:
    return chain((class_id.isin(*person), "person"), (class_id.isin(*vehicle), "vehicle"), other="ignored")


def source_label(by_source: Column, first: str, second: str) -> Column:
    """Which of two sources saw an observation, from its map of confidences."""
    a, b = by_source[first].isNotNull(), by_source[second].isNotNull()
    return chain((a & b, "both"), (a, f"{first}_only"), (b, f"{second}_only"), other="none")


def above_floor(by_source: Column, floor: float = REVIEW_FLOOR) -> Column:
    """Whether any source is at or above the review floor; an empty map is below."""
    return F.coalesce(F.array_max(F.map_values(by_source)), F.lit(0.0)) >= floor


def review_tier(by_source: Column, seen_place: Column, seen_look: Column, first: str, second: str) -> Column:
    """Review priority P1, P2, P3, P3b or LOW from who saw it, how surely, and whether place and look are known already."""
    label = source_label(by_source, first, second)
    a, b = by_source[first], F.coalesce(by_source[second], F.lit(0.0))
    low, high = WORKING_BAND
    return chain(
        ((label == f"{first}_only") & (a >= low) & (a <= high), "P2"),
        (label == f"{first}_only", "P3"),
        ((label == "both") & ~(seen_place & seen_look), "P3"),
        (label == "both", "P3b"),
        ((label == f"{second}_only") & (b < REVIEW_FLOOR), "LOW"),
        ((label == f"{second}_only") & (b >= LIKELY_FLOOR) & ~seen_place, "P1"),
        (label == f"{second}_only", "P3"),
        other="LOW",
    )


def colour_bin(rgb: Column, bins: int = 4) -> Column:
    """A digit per channel from its share of the sum; 'na' for an empty array."""
    total = F.aggregate(rgb, F.lit(0.0), lambda a, v: a + v) + 1e-6
    digits = F.transform(F.slice(rgb, 1, 3), lambda v: F.least(F.floor(v / total * bins), F.lit(bins - 1)).cast("string"))
    return F.when(F.size(rgb) > 0, F.array_join(digits, "")).otherwise("na")


def coverage_set(**parts: Column) -> Column:
    """``name:value`` of all parts that are not null, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.concat(F.lit(f"{n}:"), v.cast("string")) for n, v in parts.items()])))


def change_kind(before: Column, after: Column, least_area: float, cap: float = 0.001, moved: float = 0.05) -> Column:
    """added, removed, moved, uncertain or unchanged between two snapshots (structs of area, cx, cy, visual).

    A change of the area or of the centre counts only if the picture itself has changed a little, too.
    """
    delta, seen = after.area - before.area, after.visual >= min(least_area, cap)
    far = F.sqrt((after.cx - before.cx) * (after.cx - before.cx) + (after.cy - before.cy) * (after.cy - before.cy))
    shifted = F.coalesce(far >= moved, F.lit(False)) & (F.greatest(before.area, after.area) > 0)
    return chain(((delta >= least_area) & seen, "added"), ((delta <= -least_area) & seen, "removed"), (shifted & seen, "moved"), (after.visual >= least_area, "uncertain"), other="unchanged")


def evidence_strength(episodes: Column, cameras: Column, few: int = 20, many: int = 50, wide: int = 3) -> Column:
    return chain((episodes < few, "exploratory"), (episodes < many, "directional"), (cameras >= wide, "stronger"), other="directional")


def compare_verdict(rate: Column, base_rate: Column, fp: Column, base_fp: Column) -> Column:
    """Whether a second run is better: by its hit rate in points and its false positives a hundred frames. Nulls are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gain = (zero(rate) - zero(base_rate)) * 100.0
    worse = (zero(base_fp) > 0) & (zero(fp) > zero(base_fp) * 2.0) & (zero(fp) - zero(base_fp) > 20)
    return chain(((gain < -3.0) | worse, "regression"), ((gain >= 10.0) & (zero(fp) <= F.greatest(zero(base_fp) + 20.0, zero(base_fp) * 2.0)), "positive"), (gain < 5.0, "no change"), other="inconclusive")


def rank_band(rank: Column, bands: list[tuple[str, int, int]]) -> Column:
    """Name of the band [low, high] of a rank; a rank outside all bands is an error."""
    out = F
    for name, low, high in bands:
        out = out.when(rank.between(low, high), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("rank outside all bands: "), rank.cast("string"))).cast("string"))


def mean_difference(a: Column, b: Column, scale: float = 255.0) -> Column:
    """Mean absolute difference of two vectors over ``scale``; 1 for vectors of other or no length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), 1.0).otherwise(total / (F.size(a) * scale))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def eligibility(truth_ok: Column, source_ok: Column, localised: Column) -> Column:
    """'eligible', or the first reason against; what is unknown is not ok."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return chain((~ok(truth_ok), "truth not confirmed"), (~ok(source_ok), "source missing"), (~ok(localised), "not localised"), other="eligible")


def box_faults(b: Column, width: float, height: float, least_side: float) -> Column:
    """Why a box is not valid: no number, not ordered, outside the canvas, too small. Empty for a valid one."""
    sides = [b.x0, b.y0, b.x1, b.y1]
    odd = sides[0].isNull() | sides[1].isNull() | sides[2].isNull() | sides[3].isNull()
    for s in sides:
        odd = odd | F.isnan(s) | (F.abs(s) == float("inf"))
    return reasons(
        (odd, "not finite"),
        (~odd & ((b.x1 <= b.x0) | (b.y1 <= b.y0)), "not ordered"),
        (~odd & ((b.x0 < 0) | (b.y0 < 0) | (b.x1 > width) | (b.y1 > height)), "outside"),
        (~odd & (F.least(b.x1 - b.x0, b.y1 - b.y0) < least_side), "too small"),
    )


def in_schedule(at: Column, start: Column, end: Column) -> Column:
    """Whether an instant lies in a schedule; both ends are in."""
    return (at >= start) & (at <= end)


def median_residual(a: Column, b: Column) -> Column:
    """Median absolute difference of two vectors over the places that both have; null where there are none."""
    gaps = F.array_sort(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda v: v.isNotNull()))
    n = F.size(gaps)
    return F.when(n > 0, (F.element_at(gaps, F.floor((n + 1) / 2).cast("int")) + F.element_at(gaps, (F.floor(n / 2) + 1).cast("int"))) / 2)


def usable(at: Column, now: Column, epoch: Column, current: Column, held: Column, conf: Column, most_age: float, ahead: float = 0.05) -> Column:
    """Whether an observation may steer: of the current view, measured, not from the future, not too old, with confidence.
    What is unknown is not usable."""
    return F.coalesce((epoch == current) & ~held & (at <= now + ahead) & (now - at <= most_age) & (conf > 0), F.lit(False))


def capped_score(*rules: tuple[Column, int], most: int = 100) -> Column:
    """Points of all rules whose condition holds, at most ``most``; an unknown condition gives none."""
    total = F.lit(0)
    for condition, points in rules:
        total = total + F.when(condition, points).otherwise(0)
    return F.least(total, F.lit(most))
