"""Registered queries: keys and bands, set operations, selection and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lynxframe.functions import text as T
from lynxframe.operators import lineage, metrics, records, samples
from lynxframe.operators.selection import stable_rank
from lynxframe.plans.catalogue import query
from lynxframe.sources.fixtures import load

_READ = "'京' || substr('abcdefghij', CAST(frame_no % 10 AS INT) + 1, 1) || ' ' || CAST(frame_no % 10 AS STRING) || '-' || CAST(10000 + frame_no % 9000 AS STRING)"
_ADDRESS = "'opened rtsp://user' || CAST(page_id AS STRING) || ':pw@' || replace(replace(url, 'http://', ''), 'https://', '')"


@query(f"SELECT frame_no, CASE WHEN regexp_full_match(p, '[一-鿿][A-HJ-NP-Z][A-HJ-NP-Z0-9]{{5,6}}') THEN p END AS plate FROM (SELECT frame_no, upper(regexp_replace({_READ}, '[\\s·•._-]+', '', 'g')) AS p FROM observations)", "observations")
def plate_normalise(spark, sf_dir):
    return load(spark, sf_dir, "observations").select("frame_no", T.plate(F.expr(_READ)).alias("plate"))


@query(f"SELECT page_id, regexp_replace({_ADDRESS}, '(rtsps?://)[^/\\s@]+@', '\\1***@', 'g') AS message FROM pages")
def redact_credentials(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.redacted(F.expr(_ADDRESS)).alias("message"))


@query("""SELECT stream_id, CASE WHEN h >= 6 AND h < 10 THEN 'morning' WHEN h >= 10 AND h < 16 THEN 'midday' WHEN h >= 16 AND h < 19 THEN 'evening' ELSE 'outside' END AS hours, CASE WHEN a >= 0 AND a < 0.055 THEN 'tiny' WHEN a >= 0.055 AND a < 0.08 THEN 'small' ELSE 'large' END AS size, cell, count(*) AS n FROM
(SELECT stream_id, CAST(floor(ts_s / 3600) AS BIGINT) % 24 AS h, sqrt((x1 - x0) * (y1 - y0)) AS a, CAST(CAST(floor(greatest(0, least(0.999, (y0 + y1) / 2)) * 3) AS BIGINT) AS VARCHAR) || CAST(CAST(floor(greatest(0, least(0.999, (x0 + x1) / 2)) * 4) AS BIGINT) AS VARCHAR) AS cell FROM observations) GROUP BY 1, 2, 3, 4""", "observations")
def coverage_buckets(spark, sf_dir):
    hour = F.floor(F.col("ts_s") / 3600) % 24
    side = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    hours = T.band(hour, [("morning", 6, 10), ("midday", 10, 16), ("evening", 16, 19)], "outside")
    size = T.band(side, [("tiny", 0, 0.055), ("small", 0.055, 0.08)], "large")
    cell = T.grid_cell((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    return load(spark, sf_dir, "observations").groupBy("stream_id", hours.alias("hours"), size.alias("size"), cell.alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|' || coalesce(text, '')), 1, 16) AS UBIGINT)) AS VARCHAR) AS fingerprint FROM documents GROUP BY source")
def dataset_fingerprint(spark, sf_dir):
    return lineage.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["source"], [F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))])


@query("SELECT camera, start_s, count(*) AS members, 'ep-' || substr(sha256(string_agg(CAST(file_id AS VARCHAR), '|' ORDER BY file_id)), 1, 16) AS episode_id FROM recordings GROUP BY camera, start_s", "recordings")
def member_set_ids(spark, sf_dir):
    return records.set_ids(load(spark, sf_dir, "recordings"), ["camera", "start_s"], "file_id", "ep-").withColumnRenamed("set_id", "episode_id")


@query("SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def review_state(spark, sf_dir):
    state = F.when(F.col("quality") == 1, "accepted").otherwise("rejected")
    rows = records.decided(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", state)
    return rows.groupBy("source", "decision").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def not_yet_reviewed(spark, sf_dir):
    return records.unseen(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


@query("SELECT CASE WHEN d.doc_id IS NULL THEN 'labels only' WHEN l.doc_id IS NULL THEN 'documents only' ELSE 'both' END AS side, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def id_set_difference(spark, sf_dir):
    a, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return records.sides(a, b, "doc_id", ("documents", "labels")).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return records.repeated(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query("AS_ u AS (SELECT frame_id, 'detector' AS origin, conf FROM detections UNION ALL SELECT frame_id, 'truth', NULL FROM truth_boxes) SELECT frame_id, origin, count(*) AS n, max(conf) AS best FROM u GROUP BY 1, 2", "detections", "truth_boxes")
def union_of_sources(spark, sf_dir):
    found = load(spark, sf_dir, "detections").select("frame_id", "conf")
    both = records.union_of({"detector": found, "truth": load(spark, sf_dir, "truth_boxes").select("frame_id")})
    return both.groupBy("frame_id", "origin").agg(F.count("*").alias("n"), F.max("conf").alias("best"))


@query("SELECT stream_id, frame_no, first_value(frame_no) OVER w AS first_no, row_number() OVER w > 1 AS duplicate FROM observations WINDOW w AS (PARTITION BY stream_id, x0, y0, kind ORDER BY ts_s, frame_no)", "observations")
def first_of_key(spark, sf_dir):
    rows = load(spark, sf_dir, "observations")
    return records.first_sightings(rows, ["stream_id", "x0", "y0", "kind"], ["ts_s", "frame_no"], "frame_no").select("stream_id", "frame_no", "first_no", "duplicate")


@query("""AS_ m AS (SELECT device, sample_id, passed, abs(score - 0.4) AS margin, CASE WHEN passed THEN 'passed' ELSE 'filtered' END AS side FROM scored), s AS (SELECT *, ntile(2) OVER (PARTITION BY device, side ORDER BY margin, sha256(side || '|' || CAST(sample_id AS VARCHAR))) AS half FROM m),
r AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY device, side, half) AS n FROM s WINDOW w AS (PARTITION BY device, side, half ORDER BY margin, sha256('pick|' || CAST(sample_id AS VARCHAR))))
SELECT device, side || CASE WHEN half = 1 THEN '_near' ELSE '_spread' END AS stratum, sample_id FROM r WHERE n <= 5 OR k IN (SELECT CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) FROM range(5) t(i))""", "scored")
def margin_strata_picks(spark, sf_dir):
    rows = load(spark, sf_dir, "scored").withColumn("margin", F.abs(F.col("score") - 0.4)).withColumn("side", F.when(F.col("passed"), "passed").otherwise("filtered"))
    halves = Window.partitionBy("device", "side").orderBy("margin", F.sha2(F.concat_ws("|", "side", F.col("sample_id").cast("string")), 256))
    rows = rows.withColumn("half", F.ntile(2).over(halves))
    by = Window.partitionBy("device", "side", "half")
    ranked = rows.withColumn("k", F.row_number().over(by.orderBy("margin", stable_rank("pick", F.col("sample_id")))) - 1).withColumn("n", F.count("*").over(by))
    spots = F.expr("transform(sequence(0, 4), i -> cast(rint(i * (n - 1) / 4.0D) as bigint))")
    picked = ranked.where((F.col("n") <= 5) | F.array_contains(spots, F.col("k").cast("long")))
    return picked.select("device", F.concat("side", F.when(F.col("half") == 1, "_near").otherwise("_spread")).alias("stratum"), "sample_id")


@query("""AS_ d AS (SELECT stream_id, frame_no, ts_s, conf, CAST(floor(ts_s / 86400) AS BIGINT) AS day, row_number() OVER (PARTITION BY stream_id, CAST(floor(ts_s / 3600) AS BIGINT), x0, y0 ORDER BY ts_s, frame_no) AS k FROM observations), c AS (SELECT *, row_number() OVER (PARTITION BY stream_id, day ORDER BY conf DESC, frame_no) AS round FROM d WHERE k = 1)
SELECT stream_id, day, round, frame_no FROM c WHERE round <= 3""", "observations")
def burst_cap(spark, sf_dir):
    out = samples.burst_cap(load(spark, sf_dir, "observations"), "stream_id", "ts_s", "frame_no", ["x0", "y0"], "conf", 3600, 86400, 3)
    return out.select("stream_id", F.col("period").alias("day"), "round", "frame_no")


@query("SELECT stream_id, frame_no, (row_number() OVER (PARTITION BY stream_id ORDER BY conf DESC, frame_no) - 1) // 50 AS batch FROM observations", "observations")
def batch_slices(spark, sf_dir):
    return records.slices(load(spark, sf_dir, "observations").select("stream_id", "frame_no", "conf"), ["stream_id"], [F.desc("conf"), F.col("frame_no")], 50).drop("conf")


@query("SELECT file_id, CASE WHEN end_s <= 788918400 THEN 'build' WHEN start_s >= 788918400 AND end_s <= 851990400 THEN 'calibration' WHEN start_s >= 851990400 THEN 'blind' ELSE 'crossing' END AS part FROM recordings", "recordings")
def time_parts(spark, sf_dir):
    inf = float("inf")
    part = samples.time_part("start_s", "end_s", [("build", -inf, 788918400), ("calibration", 788918400, 851990400), ("blind", 851990400, inf)], "crossing")
    return load(spark, sf_dir, "recordings").select("file_id", part.alias("part"))


@query("""AS_ b AS (SELECT lang, CAST(floor(score * 10) AS BIGINT) AS t, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1, 2), g AS (SELECT l.lang, x.t FROM (SELECT DISTINCT lang FROM scored) l CROSS JOIN range(10) x(t)),
s AS (SELECT g.lang, g.t, coalesce(sum(b.pos), 0) AS hit, coalesce(sum(b.n - b.pos), 0) AS fp FROM g LEFT JOIN b ON g.lang = b.lang AND b.t >= g.t GROUP BY 1, 2), a AS (SELECT lang, sum(pos) AS pos, sum(n) AS n FROM b GROUP BY 1),
r AS (SELECT s.lang, s.t, hit / a.pos AS rate, 100.0 * fp / a.n AS fp100 FROM s JOIN a ON s.lang = a.lang WHERE a.pos > 0), m AS (SELECT *, max(rate) OVER (PARTITION BY lang) AS best FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fp100, t DESC) AS k FROM m WHERE best - rate <= 0.02)
SELECT lang, CAST(t AS DOUBLE) / 10 AS threshold, round(rate, 6) AS hit_rate, round(fp100, 6) AS fp_per_100 FROM k WHERE k = 1""", "scored")
def threshold_choice(spark, sf_dir):
    return metrics.choose_threshold(load(spark, sf_dir, "scored"), "lang", 10, 0.02)


@query("AS_ r AS (SELECT device, label, sum(label) OVER w AS hits, row_number() OVER w AS k FROM scored WINDOW w AS (PARTITION BY device ORDER BY score DESC, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT device, round(sum(label * hits / k) / nullif(sum(label), 0), 6) AS average_precision FROM r GROUP BY device", "scored")
def average_precision(spark, sf_dir):
    return metrics.average_precision(load(spark, sf_dir, "scored"), "device", "sample_id")
