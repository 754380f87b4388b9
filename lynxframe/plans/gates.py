"""Registered queries: gates, whose rows are violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynxframe.operators import gates, selection
from lynxframe.plans.catalogue import query
from lynxframe.sources.fixtures import load


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("AS_ h AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT device AS source, count(*) AS expected FROM scored GROUP BY 1) SELECT coalesce(h.source, e.source) AS source, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected FROM h FULL JOIN e ON h.source = e.source WHERE coalesce(n, 0) <> coalesce(expected, 0)", "scored")
def preflight_counts(spark, sf_dir):
    expected = load(spark, sf_dir, "scored").groupBy(F.col("device").alias("source")).agg(F.count("*").alias("expected"))
    return gates.count_gate(_read(spark, sf_dir, "documents"), "source", expected)


@query("AS_ m AS (SELECT card_id AS obs_id, count(*) AS n FROM decisions GROUP BY 1) SELECT coalesce(m.obs_id, s.obs_id) AS obs_id, coalesce(n, 0) AS n, s.obs_id IS NOT NULL AS known FROM m FULL JOIN sourced s ON s.obs_id = m.obs_id WHERE coalesce(n, 0) <> 1 OR s.obs_id IS NULL", "sourced", "decisions")
def members_once(spark, sf_dir):
    members = load(spark, sf_dir, "decisions").select(F.col("card_id").alias("obs_id"))
    return gates.members_once(members, load(spark, sf_dir, "sourced"), "obs_id")


@query("SELECT episode, concat_ws(',', CASE WHEN count(DISTINCT camera) > 1 THEN 'mixed camera' END, CASE WHEN count(DISTINCT scene) > 1 THEN 'mixed scene' END) AS fault FROM (SELECT *, obs_id // 4 AS episode FROM sourced) GROUP BY 1 HAVING count(DISTINCT camera) > 1 OR count(DISTINCT scene) > 1", "sourced")
def episode_consistency(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").withColumn("episode", F.floor(F.col("obs_id") / 4))
    return gates.mixed_groups(rows, "episode", ["camera", "scene"], "ts_s", "ts_s")


@query("AS_ s AS (SELECT l_orderkey AS episode, l_linenumber % 2 AS version, list_sort(list(l_partkey)) AS m FROM lineitem GROUP BY 1, 2) SELECT episode, count(DISTINCT m) AS sets FROM s GROUP BY 1 HAVING count(DISTINCT m) > 1", "scored")
def changed_member_sets(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), (F.col("l_linenumber") % 2).alias("version"), "l_partkey")
    return gates.same_id_other_members(rows, "episode", "l_partkey")


@query("SELECT doc_id, source FROM documents d WHERE source LIKE '%1' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def review_incomplete(spark, sf_dir):
    asked = _read(spark, sf_dir, "documents").select("doc_id", "source").where("source like '%1'")
    return gates.not_reviewed(asked, _read(spark, sf_dir, "labels"), "doc_id")


_SPLIT = "sp AS (SELECT sample_id, device, label, CASE WHEN row_number() OVER (PARTITION BY device ORDER BY sha256('{seed}|' || CAST(sample_id AS VARCHAR))) <= floor(count(*) OVER (PARTITION BY device) * {share}) THEN 'holdout' ELSE 'train' END AS split FROM scored)"


def _split(spark, sf_dir, share, seed):
    return selection.split_holdout(load(spark, sf_dir, "scored"), "device", "sample_id", share, seed, F.lit(False)).select("sample_id", "device", "label", "split")


@query(f"AS_ {_SPLIT.format(seed='h', share='0.2')}, {_SPLIT.format(seed='h', share='0.25').replace('sp AS', 'sq AS')} SELECT sp.sample_id, sp.split AS was, sq.split AS now FROM sp JOIN sq ON sp.sample_id = sq.sample_id WHERE sp.split <> sq.split", "scored")
def split_drift(spark, sf_dir):
    return gates.split_drift(_split(spark, sf_dir, 0.2, "h"), _split(spark, sf_dir, 0.25, "h"), "sample_id")


@query(f"AS_ {_SPLIT.format(seed='h', share='0.2')}, p AS (SELECT *, sample_id // 6 AS tile FROM sp WHERE sample_id % 3 <> 1), m AS (SELECT tile FROM p GROUP BY 1 HAVING min(label) <> max(label)) SELECT sample_id, 'held out' AS fault FROM p WHERE split = 'holdout' UNION ALL SELECT sample_id, 'both polarities' FROM p WHERE tile IN (SELECT tile FROM m)", "scored")
def training_pool_faults(spark, sf_dir):
    rows = _split(spark, sf_dir, 0.2, "h")
    pool = rows.where("sample_id % 3 <> 1").withColumn("tile", F.floor(F.col("sample_id") / 6))
    return gates.pool_faults(pool, rows.where("split = 'holdout'"), "sample_id", "tile", "label", [0, 1])


@query(f"AS_ {_SPLIT.format(seed='s', share='0.3')} SELECT d.doc_id AS sample_id FROM documents d JOIN sp ON sp.sample_id = d.doc_id AND sp.split = 'holdout' WHERE d.lang = 'en'", "scored")
def sealed_rows_read(spark, sf_dir):
    read = _read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("sample_id"))
    return gates.sealed_rows(read, _split(spark, sf_dir, 0.3, "s").where("split = 'holdout'"), "sample_id")


@query("AS_ l AS (SELECT card_id AS obs_id, decision FROM decisions WHERE decision = 'confirmed') SELECT s.obs_id, s.kind FROM sourced s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.obs_id = s.obs_id)", "sourced", "decisions")
def incremental_work(spark, sf_dir):
    ledger = load(spark, sf_dir, "decisions").select(F.col("card_id").alias("obs_id"), F.when(F.col("decision") == "confirmed", "committed").otherwise("open").alias("status"))
    return gates.not_done(load(spark, sf_dir, "sourced").select("obs_id", "kind"), ledger, ["obs_id"])


@query("AS_ w AS (SELECT file_id FROM recordings WHERE start_s >= 788918400 AND start_s < 820454400), h AS (SELECT file_id FROM recordings WHERE (start_s >= 788918400 AND end_s <= 804660000) OR (start_s >= 804660000 AND start_s < 820454400)) SELECT coalesce(w.file_id, h.file_id) AS file_id, CASE WHEN w.file_id IS NULL THEN 'right only' ELSE 'left only' END AS side FROM w FULL JOIN h ON w.file_id = h.file_id WHERE w.file_id IS NULL OR h.file_id IS NULL", "recordings")
def truncated_window(spark, sf_dir):
    start, end = F.col("start_s"), F.col("end_s")
    whole = (start >= 788918400) & (start < 820454400)
    return gates.halves_gate(load(spark, sf_dir, "recordings"), "file_id", whole, (start >= 788918400) & (end <= 804660000), (start >= 804660000) & (start < 820454400))
