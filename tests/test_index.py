"""The stored inverted index, block search and counted ranks, against plain Python and the plans without them."""

import glob
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.operators import dense, fusion, lexical


def okapi(corpus, queries):
    """Scores of each query with each document, zeros included."""
    import re

    tokens = {i: re.findall("[a-z0-9$%.]+", (t or "").lower()) for i, t in corpus}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = round(0.25 * sum(raw.values()) / len(raw), 9)
    out = {}
    for q, text in queries:
        for i, ts in tokens.items():
            tf = Counter(ts)
            out[q, i] = round(sum((raw[t] if raw[t] >= 0 else floor) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in re.findall("[a-z0-9$%.]+", (text or "").lower()) if t in raw), 6)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("the The cost of 3.5% gain loss $7 year a b c d e f g".split()) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    return [*rows, (150, None), (151, ""), (152, "—"), (153, "the " * 5000), (154, "rare word"), (155, "word")]


def test_index_scores_every_document_and_grows_by_batches(spark, corpus, tmp_path):
    queries = [(1, "the cost of the rare word"), (2, "unknown words only zzz"), (3, ""), (4, None), (5, "gain 3.5% $7")]
    schema = "id long, text string"
    q = spark.createDataFrame(queries, "query_id long, text string")
    index = lexical.build(spark.createDataFrame(corpus[:60], schema), str(tmp_path / "i"))
    first = okapi(corpus[:60], queries)
    assert {(r.query_id, r.id): r.score for r in index.search_all(q).collect()} == pytest.approx(first, abs=2e-6)
    index.append(spark.createDataFrame(corpus[60:], schema)).append(spark.createDataFrame([], schema))
    want = okapi(corpus, queries)
    have = {(r.query_id, r.id): r.score for r in index.search_all(q).collect()}
    assert have.keys() == want.keys() and have == pytest.approx(want, abs=2e-6)
    some = {(r.query_id, r.id): r.score for r in index.search(q).collect()}
    plain = {(r.query_id, r.id): r.score for r in lexical.bm25(spark.createDataFrame(corpus, schema), q).collect()}
    assert some == pytest.approx(plain, abs=2e-6) and {k for k, v in want.items() if v} <= some.keys()


def test_index_reads_the_buckets_of_wanted_terms_alone(spark, corpus, tmp_path):
    index = lexical.build(spark.createDataFrame(corpus, "id long, text string"), str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "rare gain")], "query_id long, text string")
    plan = index.search(q)._jdf.queryExecution().sparkPlan().toString()
    bucket = {r.b for r in q.select(F.explode(F.split("text", " ")).alias("term")).select(lexical._bucket(lexical.BUCKETS).alias("b")).collect()}
    assert len(bucket) == 2 and len(glob.glob(f"{tmp_path}/i/postings/batch=*/bucket=*")) > 10
    read = [line for line in plan.splitlines() if "PartitionFilters" in line and "tf#" in line]
    assert read and all(str(b) in read[-1] for b in bucket)


def test_index_ignores_batches_that_were_not_finished(spark, corpus, tmp_path):
    index = lexical.build(spark.createDataFrame(corpus[:50], "id long, text string"), str(tmp_path / "i"))
    spark.createDataFrame([(999, 1, "cost", 1)], "id long, dl int, term string, tf long").withColumn("bucket", lexical._bucket(lexical.BUCKETS)).write.partitionBy("bucket").parquet(f"{tmp_path}/i/postings/batch=dead")
    q = spark.createDataFrame([(1, "cost")], "query_id long, text string")
    assert 999 not in {r.id for r in index.search(q).collect()}


def test_index_without_tokens(spark, tmp_path):
    q = spark.createDataFrame([(1, "cost")], "query_id long, text string")
    index = lexical.build(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), str(tmp_path / "i"))
    assert index.search(q).count() == 0 and [r.score for r in index.search_all(q).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="64 buckets"):
        lexical.Index(spark, str(tmp_path / "i"), 8).search(q)
    nothing = lexical.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "j"))
    assert nothing.search(q).count() == 0 and nothing.search_all(q).count() == 0


@pytest.mark.parametrize("sizes", [(16_384, 1024, 32, 4_000_000), (13, 5, 4, 40)])
def test_block_search_equals_all_products(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "LEAST", "PARTS", "SCORES"), sizes, strict=True):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(2)
    rows = [(f"v{i:03}", [float(x) for x in rng.integers(-2, 3, 4)], [None, 0, 1][i % 3]) for i in range(90)]
    asks = [(i, rows[i][1], rows[i][2]) for i in range(40)]
    v, q = spark.createDataFrame(rows, "id string, vector array<float>, label int"), spark.createDataFrame(asks, "query_id long, vector array<float>, label int")
    for on in (None, "label"):
        want = {}
        for name, x, label in asks:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y, own in rows if on is None or own == label)[:4]
            want |= {(name, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
        assert {(r.query_id, r["rank"]): (r.id, r.score) for r in dense.search(v, q, 4, on=on).collect()} == want
    assert dense.search(v.limit(0), q, 4).count() == 0 and dense.search(v, q.limit(0), 4, on="label").count() == 0


def test_global_ranks_equal_row_numbers(spark):
    rng = random.Random(1)
    rows = [(q, i, float(rng.randint(0, 6))) for q in range(4) for i in range(200) if rng.random() < 0.8]
    scored = spark.createDataFrame(rows, "query_id long, id long, score double")
    asked = spark.createDataFrame([(q, i) for q in range(5) for i in range(0, 210, 9)], "query_id long, id long")
    want = {(r.query_id, r.id): r.n for r in fusion.ranked(scored, "n").join(asked, ["query_id", "id"]).collect()}
    assert {(r.query_id, r.id): r.n for r in fusion.global_ranks(asked, scored, "n").collect()} == want
    assert fusion.global_ranks(asked, scored.limit(0), "n").count() == 0
