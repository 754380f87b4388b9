"""Ranked search, phrase mining and the quality classifier, against plain computations and held-out labels."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lynxframe.llm import classifier, collocations, oracles, queries, ranking

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score long, n long, words string, rank int, label int, quality int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_docs(n=150, seed=3):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "naïve", "ÉCOLE", "x1", "İ", "z\x1cz"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary[:8] if r.random() < 0.4 else vocabulary) for _ in range(r.choice([0, 1, 5, 30, 200]))]
        text = "".join(w + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "-", "\x1f"]) for w in words)
        if i % 3 == 0:
            text += " New York City hall; new york city "
        rows.append((i, text, r.choice(["en", "fr", None])))
    rows += [(n, None, "en"), (n + 1, "", None), (n + 2, " .\n\t", "fr"), (None, rows[3][1], "en"), (None, None, None), (5, rows[5][1], "en"), (n + 3, "of " * 20_000 + "w1 w2 " * 300, "en")]
    rows += [(n + 10 + i, rows[9][1], "en") for i in range(40)]
    r.shuffle(rows)
    return [(*x, 1, 2, "w", 3, 4, 1) for x in rows]


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


ITEMS = [(1, "The w1 w2 new york"), (2, "of OF of"), (3, ""), (4, None), (5, "nowhere"), (6, "naïve École ÉCOLE, İ"), (6, "x1 w7"), (7, "of"), (7, "of"), (None, "w3 w3 city")]


def plain_ranking(rows, items, k=10):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(r[0], Counter(term.findall(lower(r[1])))) for r in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(term.findall(lower(text)))
    out = []
    for item, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scored = []
        for doc_id, c in docs:
            n = sum(c.values())
            m = 10 + 90 * n * n_docs // total
            score = sum(x * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, x in w.items() if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("block, per_pass", [(ranking.BLOCK, ranking.ITEMS), (600, 2)])
def test_ranking_is_the_plain_one(spark, docs, rows, block, per_pass, monkeypatch):
    items = spark.createDataFrame([(*x, 9, 9) for x in ITEMS], "item_id long, text string, score long, rank int")
    monkeypatch.setattr(ranking, "BLOCK", block)
    index, n_docs = ranking.build_index(docs)
    found = ranking.search(index, n_docs, items, 10, per_pass)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain_ranking(rows, ITEMS)))


def test_index_has_every_row_and_every_posting(docs, rows):
    index, _ = ranking.build_index(docs)
    ids = [x for r in index.where("ids is not null").select("ids").collect() for x in r.ids]
    assert sorted(ids) == sorted(ranking.NO_ID if r[0] is None else r[0] for r in rows)
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    counts = [Counter(term.findall(lower(r[1]))) for r in rows]
    got = index.where("term is not null").agg(F.sum(F.size("ords")), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    assert tuple(got) == (sum(len(c) for c in counts), sum(sum(c.values()) for c in counts))


def test_strata_below_the_bar_are_not_scored(monkeypatch):
    best = ranking._Best([np.array([0])], np.array([7]), np.array([1000]), 2)
    added = []
    monkeypatch.setattr(best, "add", lambda item, scores, ids: (added.append(len(scores)), ranking._Best.add(best, item, scores, ids)))
    m, sizes = np.array([10, 50, 900]), np.array([3, 3, 4])
    best.visit(m, sizes, np.arange(10), np.array([7]), np.array([10]), np.arange(10), np.ones(10, np.int64))
    assert sum(added) == 3 and best.kept[0][1].tolist() == [0, 1]


def test_ranking_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.ranked_search(empty, items).count() == 0
    assert ranking.ranked_search(docs, items.limit(0)).count() == 0
    assert ranking.ranked_search(docs.where("text is null"), items).count() == 0


def grams(rows, longest):
    f = defaultdict(Counter)
    for r in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(r[1])):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f[r[2] or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def plain_phrases(rows, longest=3, least=10, top=2000, inside=50):
    out = []
    for lang, f in grams(rows, longest).items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        around = Counter()
        for k, v in found.items():
            for size in range(2, len(k)):
                for i in range(len(k) - size + 1):
                    around[k[i : i + size]] = max(around[k[i : i + size]], v)
        kept = []
        for k, a in found.items():
            score, _, l, r = min((1_000_000 * a * a // (f[k[:c]] * f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k)))
            if not 100 * around[k] >= inside * a:
                kept.append((-score, -a, " ".join(k).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return out


@pytest.mark.parametrize("longest, least, top, shards", [(3, 10, 2000, 4), (2, 2, 7, 3), (5, 3, 50, 2), (3, 10, 2000, 1)])
def test_phrases_are_the_plain_ones(docs, rows, longest, least, top, shards):
    found = collocations.collocations(docs, longest, least, top, shards=shards)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    theirs = plain_phrases(rows, longest, least, top)
    assert theirs and sorted(map(tuple, found.collect())) == sorted(theirs)


def test_phrases_with_a_bitmap_that_is_full(docs, rows, monkeypatch):
    """Filters that let everything pass cost work, not results."""
    real = collocations.frequent_phrases
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *x: real(*x, size=2048))
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == sorted(plain_phrases(rows))


def test_longer_phrases_are_taken_up_within_a_cycle(spark, monkeypatch):
    """Frequent parts let pairs and triples be counted before the first cycle ends; each shard counts a phrase once."""
    seen = []
    real = collocations.count_step
    monkeypatch.setattr(collocations, "count_step", lambda longest, first, now, before: (seen.append([x for x in now if now[x].bits is not None]), real(longest, first, now, before))[1])
    docs = spark.createDataFrame([(i, "a b c d", "en") for i in range(400)], "doc_id long, text string, lang string").repartition(3)
    got = {r.phrase: r.a for r in collocations.collocations(docs, inside_percent=101).collect()}
    assert got == {"a b": 400, "b c": 400, "c d": 400, "a b c": 400, "b c d": 400}
    assert seen[:4] == [[], [1], [1, 2], [1, 2, 3]] and len(seen) < 8


def test_each_shard_counts_a_phrase_once():
    """Whatever the filters of the scans were, as long as they only grow."""
    r = np.random.default_rng(3)
    words = r.integers(0, 9, 400)
    prints = [collocations._fingerprints(words, k) for k in (1, 2, 3)]

    class Some:
        def __init__(self, share, k):
            self.limit = np.quantile(prints[k - 1].astype(float), share)

        def holds(self, x):
            return x.astype(float) <= self.limit

    none = {k: Some(-0.0, k) for k in (1, 2)}
    for f in none.values():
        f.limit = -1
    growing = [{k: Some(share, k) for k in (1, 2)} for share in (0.3, 0.6, 1.0)]
    counted = Counter()
    for cycle, now in enumerate(growing):
        for length, at, _ in collocations.active_phrases(words, 3, cycle == 0, now, growing[cycle - 1] if cycle else none):
            counted.update((length, int(x)) for x in at)
    assert set(counted.values()) == {1} and Counter(k for k, _ in counted) == {k: sum(0 not in words[i : i + k] for i in range(401 - k)) for k in (1, 2, 3)}


def test_products_beyond_64_bits(spark):
    made = spark.createDataFrame([(10**9, 3 * 10**9, 10**9)], "a long, l long, r long")
    expr = "(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"
    assert made.selectExpr(expr).first()[0] == 10**6 * 10**18 // (3 * 10**18)


def test_phrases_of_nothing(docs, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.where("text is null")).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    theirs = con.execute(oracles.SQL[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.QUERIES[name](spark, SF)
    assert sorted(ours.columns) == sorted(columns)
    a = ours.select(*columns).collect()
    assert a and Counter(map(tuple, a)) == Counter(theirs.fetchall())


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op12_quality_classifier(spark, sf)
    return out.collect(), {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}, spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_held_out_quality(judged):
    got, labels, docs = judged
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    pairs = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q, _ in pairs if q == 1], [s for s, q, _ in pairs if q == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum(p == q for _, q, p in pairs) / len(pairs) > 0.95


def test_scores_take_only_texts_and_never_held_out_labels(spark, docs):
    made = [(i, " ".join(["word", "other", "thing"][(i + k) % 3] + ("###" if i % 2 else "") for k in range(80)), "en", "s") for i in range(200)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(200)], "doc_id long, quality int")
    first = {r.doc_id: r.score for r in classifier.classify(table, labels).collect()}
    assert all((s > 0.5) == (i % 2 == 0) for i, s in first.items())
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    again = classifier.classify(table.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert {r.doc_id: r.score for r in again.collect()} == first
    moved = classifier.classify(table, labels.withColumn("quality", F.lit(None).cast("int"))).collect()
    assert {r.score for r in moved} == {0.5}


def test_classifier_of_nulls_and_nothing(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (6, 0), (7, 1)], "doc_id long, quality int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert classifier.classify(empty, labels).count() == 0
    assert {r.score for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_statistics_of_a_text_by_hand():
    x = dict(zip(classifier.STATISTICS, classifier.statistics(pa.array(["Ab cd cd.\n\nAb cd cd.\n", None, ""]))[0], strict=True))
    assert math.isclose(x["upper"], 2 / 21) and math.isclose(x["distinct_words"], 3 / 6) and math.isclose(x["commonest_word"], 2 / 6)
    assert math.isclose(x["repeated_pairs"], 4 / 5) and math.isclose(x["repeated_triples"], 2 / 4) and math.isclose(x["repeated_lines"], 1 / 2)
    assert math.isclose(x["word_bytes"], 14 / 6) and x["odd_ends"] == 0 and math.isclose(x["blank_lines"], 2 / 4)
    assert not classifier.statistics(pa.array(["a", None, ""]))[1:].any()


def test_flat_trees_go_as_a_plain_walk():
    r = np.random.default_rng(5)
    rows = r.normal(size=(400, 6))
    labels = (rows[:, 1] + (rows[:, 3] > 0.5) > 0.2).astype(float)
    trees = classifier.fit(rows, labels, n_trees=12, depth=3)
    got = trees.score(rows)
    for row, score in zip(rows[:50], got[:50], strict=True):
        total = trees.base
        for f, limit, leaf in zip(trees.feature, trees.limit, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > limit[node] else 1)
            total += leaf[node - len(f)]
        assert math.isclose(score, 1 / (1 + math.exp(-total)))
    assert ((got > 0.5) == labels).mean() > 0.95
