"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lynxframe.plans import boxes, catalogue

SF = "/root/testdata/sf0.001"
#: Queries with ratios that fall on the half of the last place, on ten times the rows.
TIES = ["box_geometry", "detection_quality", "hourly_budget", "plate_vote_consensus", "roi_snapshots", "tile_coordinates"]


def plain(v):
    """Floats to nine digits: queries round to six places in one arithmetic, so no tie is left to either engine."""
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    theirs = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    a = Counter(tuple(map(plain, r)) for r in ours.select(*columns).collect())
    b = Counter(tuple(map(plain, r)) for r in theirs.fetchall())
    assert a and a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


@pytest.mark.parametrize("name", TIES)
def test_same_rows_at_ten_times_the_size(spark, name):
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    theirs = con.execute(catalogue.SQL[name])
    columns = [d[0] for d in theirs.description]
    a = Counter(tuple(map(plain, r)) for r in catalogue.QUERIES[name](spark, sf).select(*columns).collect())
    assert a == Counter(tuple(map(plain, r)) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_matches_are_one_to_one(spark):
    out = boxes.frame_match_truth(spark, SF)
    n = out.count()
    assert n == out.select("frame_id", "det_id").distinct().count() == out.select("frame_id", "gt_id").distinct().count()
