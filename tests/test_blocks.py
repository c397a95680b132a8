"""Scores are summed inside blocks of documents: nothing is shuffled by query and document, and what is kept equals the plain ranking."""

import random

import pytest

from quaestor.operators import dense, fusion, lexical


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rng = random.Random(8)
    words = "the The cost of 3.5% gain loss $7 año a b c d e f g".split()
    rows = [(f"d{i:03}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [("none", None), ("long", "cost " * 70_000)]
    queries = [(1, "the cost of the gain"), (2, "unknown zzz"), (3, None), (4, "a b c a"), (5, "loss")]
    corpus, q = spark.createDataFrame(rows, "id string, text string"), spark.createDataFrame(queries, "query_id long, text string")
    index = lexical.build(corpus.where("id < 'd100'"), str(tmp_path_factory.mktemp("blocks")), 4).append(corpus.where("id >= 'd100'"))
    return index, corpus, q, lexical.bm25(corpus, q).cache()


@pytest.mark.parametrize("sizes", [(200_000, 4096, 1_000_000, 32, 512, 1_000_000), (50, 7, 300, 2, 2, 10)])
def test_what_blocks_keep(spark, both, monkeypatch, sizes):
    index, corpus, q, scored = both
    for name, value in zip(("HELD", "HEIGHT", "PART", "PARTS", "WIDTH", "SCORES"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, value)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(lexical.bm25(corpus, q), "query_id", "id", "score") == rows(scored, "query_id", "id", "score") == rows(index.search(q), "query_id", "id", "score")
    allowed = corpus.where("id LIKE '%7'").select("id")
    assert rows(index.search(q, allowed), "query_id", "id", "score") == rows(scored.join(allowed, "id"), "query_id", "id", "score") != []
    for only in (None, allowed, allowed.limit(0)):
        want = scored if only is None else scored.join(only, "id")
        assert rows(index.best(q, 6, only), "query_id", "rank", "id", "score") == rows(dense.top_k(want, 6), "query_id", "rank", "id", "score")
    asked = q.select("query_id").join(corpus.where("id LIKE '%3' OR id = 'none' OR id = 'long'").select("id")).union(spark.createDataFrame([(1, "unknown")], "query_id long, id string"))
    assert rows(index.scores_of(q, asked), "query_id", "id", "score") == rows(scored.join(asked, ["query_id", "id"]), "query_id", "id", "score")
    assert rows(index.ranks(q, asked, "n"), "query_id", "id", "n") == rows(fusion.global_ranks(asked, scored, "n"), "query_id", "id", "n") != []


def test_no_scores_are_shuffled_to_be_summed(both):
    index, corpus, q, _ = both
    for found in (index.search(q), lexical.bm25(corpus, q)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(query_id, id" not in "".join(c for c in plan if c not in "#0123456789L")


def test_texts_are_read_once_without_an_index(both):
    """Blocks are made once and stored; counts of terms and scores come from the stored ones."""
    _, corpus, q, scored = both
    plan = lexical.bm25(corpus, q)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Scan parquet") >= 2
