"""Observation tables derived from the driver's tables, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.operators import blocks

#: name -> (base tables, the same SELECT for both engines but for what stands in braces)
_SELECT = {
    "observations": "SELECT 'cam_' || CAST(user_id % 8 AS STRING) AS stream_id, {micros} / 1000000 AS ts_s, event_id AS frame_no, user_id AS track_id, event_type AS kind, value, CAST((event_id * 37) % 80 AS DOUBLE) / 100 AS x0, CAST((event_id * 53) % 80 AS DOUBLE) / 100 AS y0, CAST((event_id * 37) % 80 + 4 + event_id % 9 AS DOUBLE) / 100 AS x1, CAST((event_id * 53) % 80 + 4 + event_id % 7 AS DOUBLE) / 100 AS y1, CAST(event_id % 97 AS DOUBLE) / 97 AS conf FROM events",
    "detections": "SELECT l_orderkey AS frame_id, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS det_id, l_partkey % 3 AS class_id, CAST((l_partkey * 13) % 60 AS DOUBLE) AS x0, CAST((l_suppkey * 17 + l_linenumber * 5) % 60 AS DOUBLE) AS y0, CAST((l_partkey * 13) % 60 + 20 + l_partkey % 21 AS DOUBLE) AS x1, CAST((l_suppkey * 17 + l_linenumber * 5) % 60 + 20 + l_suppkey % 21 AS DOUBLE) AS y1, CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS conf, l_returnflag FROM lineitem",
    "truth_boxes": "SELECT frame_id, det_id AS gt_id, x0 + 3 AS x0, y0 + 3 AS y0, x1 + 3 AS x1, y1 + 3 AS y1 FROM detections WHERE l_returnflag = 'R'",
    "zones": "SELECT 'cam_' || CAST(s.id AS STRING) AS stream_id, z.zone_id, z.kind, z.x0, z.y0, z.x1, z.y1 FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS s(id) CROSS JOIN (VALUES ('left', 'roi', 0.0, 0.0, 0.5, 1.0), ('diamond', 'roi', 0.2, 0.2, 0.8, 0.8), ('corner', 'exclude', 0.0, 0.0, 0.2, 0.2)) AS z(zone_id, kind, x0, y0, x1, y1)",
    "recordings": "SELECT o_custkey % 8 AS camera, o_orderkey AS file_id, {o_micros} / 1000000 AS start_s, {o_micros} / 1000000 + 43200 AS end_s FROM orders",
    "scored": "SELECT d.doc_id AS sample_id, d.source AS device, CAST((d.doc_id * 31) % 1000 AS DOUBLE) / 1000 AS score, CAST(l.quality AS BIGINT) AS label, 1 + d.doc_id % 5 AS weight, (d.doc_id * 31) % 1000 >= 400 AS passed, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "metrics": "SELECT stream_id, ts_s, frame_no, kind, sum(25) OVER w AS captured, sum(CASE WHEN kind = 'error' THEN 0 ELSE 24 END) OVER w AS published, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER w AS corrupt FROM observations WINDOW w AS (PARTITION BY stream_id ORDER BY ts_s, frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "cells": "SELECT vec_id AS frame_id, vec_id % 8 AS camera, CAST(p.pos AS INT) AS cell, CAST(p.gray AS DOUBLE) AS gray FROM {cells}",
    "sourced": "SELECT event_id AS obs_id, user_id % 8 AS camera, event_id % 3 AS scene, event_type AS kind, {micros} / 1000000 AS ts_s, CAST((event_id * 37) % 1800 AS DOUBLE) AS x0, CAST((event_id * 53) % 1000 AS DOUBLE) AS y0, CAST((event_id * 37) % 1800 + 8 + event_id % 90 AS DOUBLE) AS x1, CAST((event_id * 53) % 1000 + 8 + event_id % 70 AS DOUBLE) AS y1, CASE WHEN event_id % 3 <> 1 THEN CAST((event_id * 29) % 100 AS DOUBLE) / 100 END AS first_conf, CASE WHEN event_id % 3 <> 0 THEN CAST((event_id * 43) % 100 AS DOUBLE) / 100 END AS second_conf, event_id % 5 = 0 AS seen_place, event_id % 7 < 3 AS seen_look, CAST((event_id * 11) % 256 AS DOUBLE) AS r, CAST((event_id * 17) % 256 AS DOUBLE) AS g, CAST((event_id * 23) % 256 AS DOUBLE) AS b FROM events",
    "snapshots": "SELECT 'cam_' || CAST(user_id % 8 AS STRING) AS stream_id, CAST(floor({micros} / 3600000000) AS BIGINT) AS tick, CAST(least(10000, sum((4 + event_id % 9) * (4 + event_id % 7))) AS DOUBLE) / 10000 AS area, CAST(sum(2 * ((event_id * 37) % 80) + 4 + event_id % 9) AS DOUBLE) / (200 * count(*)) AS cx, CAST(sum(2 * ((event_id * 53) % 80) + 4 + event_id % 7) AS DOUBLE) / (200 * count(*)) AS cy, CAST(min(event_id) % 12 AS DOUBLE) / 4000 AS visual FROM events GROUP BY 1, 2",
    "view_ticks": "SELECT 'cam_' || CAST(user_id % 8 AS STRING) AS stream_id, CAST(floor(event_id / 10) AS BIGINT) % 4 AS view, {micros} / 1000000 AS ts_s, event_id AS frame_no, event_id % 4 <> 1 AS scanned, event_id % 9 <> 2 AND event_id % 200 < 170 AS judged, event_id % 4 <> 1 AND event_id % 7 < 4 AS by_scan, event_id % 9 <> 2 AND event_id % 200 < 170 AND event_id % 5 < 2 AS by_prior, CAST(40 * ((event_id * 37) % 5) + 12 * (event_id % 3) AS DOUBLE) AS sx0, CAST(30 + event_id % 4 AS DOUBLE) AS sy0, CAST(40 * ((event_id * 37) % 5) + 12 * (event_id % 3) + 20 + event_id % 5 AS DOUBLE) AS sx1, CAST(54 + event_id % 7 AS DOUBLE) AS sy1, event_id % 11 = 0 AS has_actor, event_id % 13 = 0 AS has_blind, CAST(40 * ((event_id * 53) % 5) AS DOUBLE) AS ax0, CAST(10 AS DOUBLE) AS ay0, CAST(40 * ((event_id * 53) % 5) + 35 AS DOUBLE) AS ax1, CAST(90 AS DOUBLE) AS ay1, event_id % 6 = 0 AS has_residue, CAST(40 * ((event_id * 59) % 5) AS DOUBLE) AS rx0, CAST(30 AS DOUBLE) AS ry0, CAST(40 * ((event_id * 59) % 5) + 30 AS DOUBLE) AS rx1, CAST(50 AS DOUBLE) AS ry1 FROM events",
    "profile_scores": "SELECT 'cam_' || CAST(user_id % 8 AS STRING) AS stream_id, {micros} / 1000000 AS ts_s, event_id AS frame_no, CAST(p.id AS BIGINT) AS profile, CAST((CAST(floor({micros} / 259200000000) AS BIGINT) * 37 + p.id * 29 + user_id % 8 * 11) % 100 + event_id % 5 AS DOUBLE) / 100 AS score, (CAST(floor({micros} / 259200000000) AS BIGINT) * 37 + p.id * 29 + user_id % 8 * 11) % 100 < 50 AND event_id % 9 <> 0 AS enter, (CAST(floor({micros} / 259200000000) AS BIGINT) * 37 + p.id * 29 + user_id % 8 * 11) % 100 < 62 AND event_id % 19 <> 0 AS hold, (event_id + p.id) % 3 <> 0 AS sound, CAST((event_id * 7 + p.id * 31) % 50 AS DOUBLE) AS rough FROM events CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS p(id)",
    "decisions": "SELECT event_id AS decision_id, user_id * 10 + event_id % 10 AS card_id, {micros} / 1000000 AS decided_s, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'uncertain' ELSE 'pending' END AS decision FROM events",
}
_SPARK = {"micros": "unix_micros(CAST(ts AS TIMESTAMP))", "o_micros": "unix_micros(CAST(o_orderdate AS TIMESTAMP))", "cells": "embeddings LATERAL VIEW posexplode(embedding) p AS pos, gray"}
_DUCK = {"micros": "epoch_us(ts)", "o_micros": "epoch_us(o_orderdate)", "cells": "(SELECT vec_id, unnest(embedding) AS gray, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) p"}
_NEEDS = {"truth_boxes": ["detections"], "metrics": ["observations"]}
_TABLES = ("events", "lineitem", "orders", "documents", "labels", "embeddings")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, as a lazy plan over the Parquet files."""
    if name == "metrics":  # running sums over whole streams, in blocks of time
        error = F.col("kind") == "error"
        sums = {"captured": F.lit(25), "published": F.when(error, 0).otherwise(24), "corrupt": F.when(error, 1).otherwise(0)}
        rows = load(spark, sf_dir, "observations").select("stream_id", "ts_s", "frame_no", "kind")
        return blocks.running(rows, ["stream_id"], ["ts_s", "frame_no"], sums=sums)
    own = {x: load(spark, sf_dir, x) for x in _NEEDS.get(name, [])}
    sql = _SELECT[name].format(**_SPARK)
    own |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql}
    for t in own:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **own)


def duck(*names: str) -> str:
    """WITH clauses that define the tables in DuckDB."""
    needed = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_SELECT[n].format(**_DUCK)})" for n in needed)
