"""Which documents hold which questions, against plain Python."""

import random

from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.operators import containment


def test_containing_equals_all_pairs(spark):
    rng = random.Random(7)
    words = ["the", "cat", "sat", "on", "a", "mat", "Mat", "é", "🙂", "x" * 30]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "a"), (503, "  the\ncat \t sat"), (504, "the cat " * 3000)]
    questions = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    for i, (_, t) in enumerate(docs[:60]):
        at = rng.randint(0, max(0, len(t) - 1))
        questions.append((100 + i, t[at : at + rng.randint(1, 40)]))
    questions += [(300, ""), (301, " "), (302, None), (303, "t s"), (304, "he ca"), (305, "zzz"), (306, "the\ncat")]
    q, d = spark.createDataFrame(questions, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, body string")
    want = {(a, b) for a, t in questions for b, body in docs if t is not None and body is not None and t in body}
    assert {tuple(r) for r in containment.containing(q, d).collect()} == want and len(want) > 300
    form = lambda t: " ".join(t.lower().split())
    want = {(a, b) for a, t in questions for b, body in docs if t is not None and body is not None and form(t) in form(body)}
    found = containment.containing(q, d, T.lowered).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert containment.containing(q.limit(0), d).count() == 0 and containment.containing(q, d.limit(0)).count() == 0


def test_documents_are_not_shuffled_to_meet_few_candidates(spark, tmp_path):
    """Where Spark only estimates the candidates' number it takes them for as many as the documents, and shuffles both."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f "), F.col("id").cast("string"), F.repeat(F.lit(" word"), 50)).alias("body"))
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
        questions = spark.createDataFrame([(1, "e f 17 word"), (2, "none of these words")], "query_id long, text string")
        found = containment.containing(questions, docs)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert {tuple(r) for r in found.collect()} == {(1, 17)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
