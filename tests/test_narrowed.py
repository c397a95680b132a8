"""What a search of few terms shuffles: their postings alone, and no table of all terms; tokens are cut from whole batches of texts."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.operators import lexical

ODD = ["", " ", "a", "A.b c%", "İstanbul K5 Kelvin", "año 3,5% $7", "ΑΣ ß ſt", "x\x00y", "😀z😀", "end", ".", "no break", "É1", "a\nb\tc", "z" * 500]


def test_tokens_of_a_batch_are_those_of_its_texts(spark):
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice("aZ0$%. -é中😀İ\n") for _ in range(rng.randint(0, 30))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.lower("text").alias("low"), T.tokens(F.col("text")).alias("tokens")).orderBy("i").collect()
    held = pa.array(["left out", *(r.low for r in rows)]).slice(1)
    tokens, upto = lexical.tokenised(held)
    assert [tokens[a:b].to_pylist() for a, b in zip(upto, upto[1:])] == [r.tokens for r in rows]
    for none in ([], ["", ""]):
        tokens, upto = lexical.tokenised(pa.array(none, pa.string()))
        assert len(tokens) == 0 and upto.tolist() == [0] * (len(none) + 1)


def test_postings_are_narrowed_to_what_is_asked(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(60)) + " cost") for i in range(1000)]
    of = lexical.blocks(spark.createDataFrame(rows, "id long, text string").coalesce(1), 4).cache()
    held = lexical.narrowed(of, ["cost", "w7", "unknown"])
    want = {r.term: r.df for r in lexical.frequencies(of).where("term IN ('cost', 'w7')").collect()}
    assert {r.term: r.df for r in lexical.frequencies(held).collect()} == want and len(want) == 2
    size = lambda df: df.where("bucket >= 0").agg(F.sum(F.length("doc") + F.length("tf"))).first()[0]
    assert 20 * size(held) < size(of) and held.where("bucket = -1").count() == of.where("bucket = -1").count()


def test_a_search_is_the_same_with_and_without_narrowing(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("the cost of gain loss $7 a b c".split()) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    q = spark.createDataFrame([(1, "the cost of the gain"), (2, "a b zzz"), (3, None)], "query_id long, text string")
    index = lexical.build(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i"), 4)
    plan = index.best(q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in "".join(c for c in plan if c not in "#0123456789L")  # one batch: all terms were shuffled, to sum their counts
    few = sorted(map(tuple, index.search(q).collect()))
    monkeypatch.setattr(lexical, "TERMS", 2)
    assert lexical._asked(q)[1] is None and sorted(map(tuple, index.search(q).collect())) == few != []
