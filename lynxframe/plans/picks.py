"""Registered queries: selection, budgets, representatives and review order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lynxframe.operators import blocks, joins, records, samples, selection
from lynxframe.plans.catalogue import _box, query
from lynxframe.sources.fixtures import load


@query("SELECT stream_id, frame_no, kind, value FROM observations WHERE frame_no = 321", "observations")
def point_lookup(spark, sf_dir):
    return records.by_id(load(spark, sf_dir, "observations"), "frame_no", 321).select("stream_id", "frame_no", "kind", "value")


@query("AS_ r AS (SELECT *, row_number() OVER (PARTITION BY camera, kind ORDER BY coalesce(first_conf, second_conf) DESC, obs_id) <= 5 AS in_quota FROM sourced), p AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY in_quota DESC, coalesce(first_conf, second_conf) DESC, obs_id) AS place FROM r) SELECT camera, obs_id, in_quota, place FROM p WHERE place <= 30", "sourced")
def source_quota(spark, sf_dir):
    order = [F.desc(F.coalesce("first_conf", "second_conf")), F.col("obs_id")]
    return selection.quota_then_refill(load(spark, sf_dir, "sourced"), "camera", "kind", order, 5, 30).select("camera", "obs_id", "in_quota", F.col("place").cast("long").alias("place"))


_S = "coalesce(first_conf, 0)"
_U = "coalesce(second_conf, 0)"


@query(f"""AS_ a AS (SELECT camera, obs_id, row_number() OVER (PARTITION BY camera ORDER BY abs({_S} - {_U}) DESC, obs_id) AS place FROM sourced WHERE abs({_S} - {_U}) >= 0.4), a1 AS (SELECT camera, obs_id, 'disagreement' AS stage, place FROM a WHERE place <= 4),
b AS (SELECT camera, obs_id, row_number() OVER (PARTITION BY camera ORDER BY abs({_S} - 0.5), obs_id) AS place FROM sourced WHERE obs_id NOT IN (SELECT obs_id FROM a1)), b1 AS (SELECT camera, obs_id, 'boundary' AS stage, place FROM b WHERE place <= 4),
c AS (SELECT camera, obs_id, row_number() OVER (PARTITION BY camera ORDER BY {_S} DESC, obs_id) AS place FROM sourced WHERE NOT seen_place AND obs_id NOT IN (SELECT obs_id FROM a1 UNION SELECT obs_id FROM b1)), c1 AS (SELECT camera, obs_id, 'likely' AS stage, place FROM c WHERE place <= 4)
SELECT * FROM a1 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM c1""", "sourced")
def learning_budget(spark, sf_dir):
    a, b = F.coalesce("first_conf", F.lit(0.0)), F.coalesce("second_conf", F.lit(0.0))
    stages = [("disagreement", F.abs(a - b) >= 0.4, [F.desc(F.abs(a - b))], 4), ("boundary", F.lit(True), [F.abs(a - 0.5)], 4), ("likely", ~F.col("seen_place"), [F.desc(a)], 4)]
    return selection.staged(load(spark, sf_dir, "sourced"), "camera", "obs_id", stages).withColumn("place", F.col("place").cast("long"))


@query("AS_ r AS (SELECT camera, obs_id, CAST(floor(ts_s / 3600) AS BIGINT) % 24 // 6 AS bin, row_number() OVER (PARTITION BY camera, CAST(floor(ts_s / 3600) AS BIGINT) % 24 // 6 ORDER BY sha256('audit|' || CAST(obs_id AS VARCHAR))) AS k FROM sourced WHERE kind <> 'purchase') SELECT camera, bin, obs_id FROM r WHERE k <= 3", "sourced")
def random_audit(spark, sf_dir):
    bins = F.floor((F.floor(F.col("ts_s") / 3600) % 24) / 6)
    rows = load(spark, sf_dir, "sourced").where("kind <> 'purchase'").withColumn("bin", bins)
    return selection.stratified(rows, ["camera", "bin"], 3, "audit", "obs_id").select("camera", "bin", "obs_id")


@query("AS_ h AS (SELECT camera, CAST(floor(start_s / 86400) AS BIGINT) // 30 AS month, CAST(floor(start_s / 86400) AS BIGINT) AS day, arg_min(file_id, (start_s, file_id)) AS file_id FROM recordings GROUP BY 1, 2, 3), p AS (SELECT *, row_number() OVER (PARTITION BY camera, month ORDER BY day) AS k, count(*) OVER (PARTITION BY camera, month) AS n FROM h) SELECT camera, month, day, file_id FROM p WHERE n <= 3 OR k - 1 IN (SELECT CAST(round_even(i * (n - 1) / 2.0, 0) AS BIGINT) FROM range(3) t(i))", "recordings")
def evenly_spaced_days(spark, sf_dir):
    day = F.floor(F.col("start_s") / 86400)
    first = load(spark, sf_dir, "recordings").groupBy("camera", F.floor(day / 30).alias("month"), day.alias("day")).agg(F.min_by("file_id", F.struct("start_s", "file_id")).alias("file_id"))
    placed = first.withColumn("at", F.row_number().over(Window.partitionBy("camera", "month").orderBy("day")))
    return selection.spread(placed, ["camera", "month"], "at", 3).select("camera", "month", "day", "file_id")


@query("AS_ r AS (SELECT camera, obs_id, CAST(floor(ts_s / 86400) AS BIGINT) AS day, kind, row_number() OVER (PARTITION BY camera ORDER BY sha256('blind|' || CAST(obs_id AS VARCHAR))) AS k FROM sourced), c AS (SELECT camera, obs_id, row_number() OVER (PARTITION BY camera, day, kind ORDER BY sha256('cover|' || CAST(obs_id AS VARCHAR))) AS n FROM r WHERE k > 10) SELECT camera, obs_id, 'random' AS how FROM r WHERE k <= 10 UNION ALL SELECT camera, obs_id, 'coverage' FROM c WHERE n = 1", "sourced")
def blind_frames(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").withColumn("day", F.floor(F.col("ts_s") / 86400))
    return samples.blind_choice(rows, "camera", ["day", "kind"], "obs_id", 10)


@query("""AS_ o AS (SELECT *, camera * 100000 + CAST(floor(ts_s / 86400) AS BIGINT) AS episode, x1 > 1790 AS truncated FROM sourced), m AS (SELECT episode, sqrt((median(x1) - median(x0)) * (median(y1) - median(y0))) AS mid FROM o GROUP BY 1), s AS (SELECT o.*, mid, row_number() OVER (PARTITION BY episode ORDER BY ts_s, obs_id) - 1 AS pos, count(*) OVER (PARTITION BY episode) AS n FROM o JOIN m USING (episode)),
c AS (SELECT *, abs(pos - (n - 1) / 2) / n + abs(sqrt((x1 - x0) * (y1 - y0)) - mid) / greatest(mid, 1e-6) + CAST(truncated AS INT) AS score FROM s) SELECT episode, count(*) AS members, arg_min(obs_id, (score, ts_s, obs_id)) AS representative FROM c GROUP BY 1""", "sourced")
def typical_members(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").withColumn("episode", F.col("camera") * 100000 + F.floor(F.col("ts_s") / 86400)).withColumn("truncated", F.col("x1") > 1790)
    return selection.typical_member(rows, "episode", "obs_id", "ts_s")


@query("""AS_ a AS (SELECT scene, min(obs_id) AS obs_id FROM sourced WHERE kind = 'error' GROUP BY 1), b AS (SELECT scene, min(obs_id) AS obs_id FROM sourced WHERE first_conf IS NULL AND obs_id NOT IN (SELECT obs_id FROM a) GROUP BY 1), c AS (SELECT scene, min(obs_id) AS obs_id FROM sourced WHERE x1 - x0 > 60 AND obs_id NOT IN (SELECT obs_id FROM a UNION SELECT obs_id FROM b) GROUP BY 1)
SELECT scene, obs_id, 'error' AS requirement FROM a UNION ALL SELECT scene, obs_id, 'one source' FROM b UNION ALL SELECT scene, obs_id, 'wide' FROM c""", "sourced")
def requirement_subset(spark, sf_dir):
    stages = [("error", F.col("kind") == "error", [], 1), ("one source", F.col("first_conf").isNull(), [], 1), ("wide", F.col("x1") - F.col("x0") > 60, [], 1)]
    return selection.staged(load(spark, sf_dir, "sourced"), "scene", "obs_id", stages).select("scene", "obs_id", F.col("stage").alias("requirement"))


_IN = "(d.x0 + d.x1) / 2 BETWEEN t.x0 AND t.x1 AND (d.y0 + d.y1) / 2 BETWEEN t.y0 AND t.y1"


@query(f"AS_ f AS (SELECT d.frame_id, d.det_id, d.conf, EXISTS (SELECT 1 FROM truth_boxes t WHERE t.frame_id = d.frame_id AND {_IN}) AS attached FROM detections d), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY attached, conf DESC, det_id) AS k FROM f) SELECT frame_id, det_id, attached, k AS place FROM r WHERE k <= 2", "detections", "truth_boxes")
def top_priors(spark, sf_dir):
    rows = load(spark, sf_dir, "detections").select("frame_id", "det_id", "conf", _box().alias("box"))
    return samples.top_priors(rows, load(spark, sf_dir, "truth_boxes").select("frame_id", _box().alias("box")), "frame_id", "det_id", "conf", 2)


@query("AS_ l AS (SELECT camera, obs_id, coalesce(first_conf, second_conf) AS conf, row_number() OVER (PARTITION BY camera, scene, CAST(floor(x0 / 300) AS BIGINT) ORDER BY coalesce(first_conf, second_conf), obs_id) AS k FROM sourced WHERE coalesce(first_conf, second_conf) < 0.4), p AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY conf, obs_id) AS place FROM l WHERE k <= 2) SELECT camera, obs_id, place FROM p WHERE place <= 8", "sourced")
def diagnostic_picks(spark, sf_dir):
    conf = F.coalesce("first_conf", "second_conf")
    low = load(spark, sf_dir, "sourced").withColumn("conf", conf).where("conf < 0.4").withColumn("cluster", F.concat_ws("|", "camera", "scene", F.floor(F.col("x0") / 300)))
    few = selection.round_robin(low, "cluster", [F.col("conf"), F.col("obs_id")], 2)
    return selection.round_robin(few.drop("round"), "camera", [F.col("conf"), F.col("obs_id")], 8).select("camera", "obs_id", F.col("round").cast("long").alias("place"))


@query("""AS_ c AS (SELECT DISTINCT camera FROM sourced), g AS (SELECT camera, x, y FROM c CROSS JOIN range(0, 16) a(x) CROSS JOIN range(0, 9) b(y) WHERE abs(x + 0.5 - 8) / 8 + abs(y + 0.5 - 4.5) / 4.5 <= 1), r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY sha256('grid|' || CAST(camera AS VARCHAR) || '|' || CAST(x AS VARCHAR) || '|' || CAST(y AS VARCHAR))) AS k FROM g) SELECT camera, x, y, k AS place FROM r WHERE k <= 6""", "sourced")
def grid_proposals(spark, sf_dir):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    region = F.array(corner(8.0, 0.0), corner(16.0, 4.5), corner(8.0, 9.0), corner(0.0, 4.5))
    return samples.grid_proposals(load(spark, sf_dir, "sourced"), "camera", 16, 9, region, 6)


@query("SELECT obs_id, row_number() OVER (ORDER BY CASE WHEN kind = 'error' THEN 0 WHEN seen_place THEN 2 ELSE 1 END, camera, ts_s, obs_id) AS place FROM sourced", "sourced")
def review_queue(spark, sf_dir):
    risk = F.when(F.col("kind") == "error", 0).when(F.col("seen_place"), 2).otherwise(1)
    rows = load(spark, sf_dir, "sourced").select("obs_id", risk.alias("risk"), "camera", "ts_s")
    return blocks.numbered(rows, [], [F.col(c) for c in ("risk", "camera", "ts_s", "obs_id")]).select("obs_id", "place")


@query("AS_ d AS (SELECT card_id, decision, decided_s, decision_id, lag(decision) OVER (PARTITION BY card_id ORDER BY decided_s, decision_id) AS before FROM decisions) SELECT card_id, decision_id, before, decision FROM d WHERE (before = 'confirmed' AND decision = 'pending') OR (before = 'rejected' AND decision = 'confirmed')", "decisions")
def decision_transitions(spark, sf_dir):
    out = samples.transitions(load(spark, sf_dir, "decisions"), ["card_id"], ["decided_s", "decision_id"], "decision", [("confirmed", "pending"), ("rejected", "confirmed")])
    return out.select("card_id", "decision_id", "before", "decision")


@query("SELECT file_id, start_s + off AS at_s, min(kind) AS kind FROM (SELECT file_id, start_s, off, 'fixed' AS kind FROM recordings CROSS JOIN (VALUES (3600), (14400), (28800)) o(off) UNION ALL SELECT file_id, start_s, 3600 * (file_id % 9), 'bonus' FROM recordings WHERE file_id % 4 = 0) GROUP BY 1, 2", "recordings")
def review_grid(spark, sf_dir):
    files = load(spark, sf_dir, "recordings").select("file_id", "start_s")
    bonus = files.where("file_id % 4 = 0").select("file_id", (F.col("start_s") + 3600 * (F.col("file_id") % 9)).alias("at_s"))
    return records.review_grid(files, "file_id", "start_s", [3600.0, 14400.0, 28800.0], bonus)


@query("AS_ e AS (SELECT card_id, count(*) AS members, count(DISTINCT decision) AS kinds, min(decided_s) AS first_s FROM decisions GROUP BY 1), l AS (SELECT card_id, arg_max(decision, (decided_s, decision_id)) AS last FROM decisions GROUP BY 1) SELECT s.camera, l.last AS decision, count(*) AS cards, CAST(sum(e.members) AS BIGINT) AS members, max(e.kinds) AS most_kinds FROM sourced s JOIN e ON e.card_id = s.obs_id JOIN l ON l.card_id = s.obs_id GROUP BY 1, 2", "sourced", "decisions")
def gold_records(spark, sf_dir):
    decisions = load(spark, sf_dir, "decisions")
    per = decisions.groupBy("card_id").agg(F.count("*").alias("members"), F.countDistinct("decision").alias("kinds"))
    last = joins.latest_decision(decisions, "card_id", "decided_s", "decision_id", ["decision"]).drop("n_decisions")
    rows = load(spark, sf_dir, "sourced").select(F.col("obs_id").alias("card_id"), "camera").join(per, "card_id").join(last, "card_id")
    return rows.groupBy("camera", "decision").agg(F.count("*").alias("cards"), F.sum("members").alias("members"), F.max("kinds").alias("most_kinds"))
