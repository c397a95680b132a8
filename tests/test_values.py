"""Expected values on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from quaestor.functions import numeric as N
from quaestor.functions import text as T
from quaestor.functions import udfs
from quaestor.operators import chunking, dense, fusion, lexical, tools
from quaestor.operators.manifest import sensitive_keys, signature


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_normal_forms(spark):
    text = F.lit("  Straße  Größe\n ÉTÉ ")
    assert one(spark, T.folded(text), T.lowered(text), T.unaccented(text)) == ["strasse grösse été", "straße größe été", "strasse grosse ete"]


def test_quotes(spark):
    body = F.lit("Supply chain disruptions could materially harm operations.")
    assert one(spark, T.supported(F.lit("MATERIALLY   harm"), body), T.supported(F.lit(""), body), T.supported(F.lit("x"), body)) == [True, False, False]
    assert one(spark, T.quote_variants(F.lit("“...abc...”")))[0] == ["“...abc...”", "...abc...", "abc"]
    assert one(spark, F.contains(T.skeleton(F.lit("it’s — “fine”")), T.skeleton(F.lit("It's -\n\"fine\""))))[0]


def test_ids(spark):
    cid = T.chunk_id(F.lit("ACME"), F.lit(2024), F.lit("1A"), F.lit(12))
    assert one(spark, cid, T.parent_id(cid)) == ["ACME-2024-1A-0012", "ACME-2024-1A-0000"]
    assert one(spark, T.hit_ids(F.lit("[ACME-2024-1A-0000] ACME FY2024\ntext [B-2024-7-0001]\n[B-2023-7-0001] B")))[0] == ["ACME-2024-1A-0000", "B-2023-7-0001"]
    years = [one(spark, T.fiscal_year(F.lit(x)))[0] for x in ("FY2024", "2024.0", " 2023 ", "true", "")]
    assert years == [2024, 2024, 2023, None, None]


def test_tolerances(spark):
    v = lambda x: F.lit(float(x))
    assert one(spark, N.close(v(99.5), v(100), 0.01), N.close(v(98), v(100), 0.01), N.close(v("nan"), v(1), 0.01), N.close(v("inf"), v("inf"), 0.01)) == [True, False, False, False]
    # the symmetric and the one-sided rule differ at the edge
    assert one(spark, N.close(v(101.005), v(100), 0.01), N.within_one_sided(v(101.005), v(100), 0.01)) == [True, False]
    assert one(spark, N.within_one_sided(v(0), v(0), 0.01), N.within_one_sided(v(1e-9), v(0), 0.01)) == [True, False]
    assert one(spark, N.rounded_of(v(2), v(2.5)), N.rounded_of(v(3), v(2.5)), N.rounded_of(v(3), v(3))) == [True, False, False]
    assert one(spark, N.percent_change(v(-50), v(25)), N.percent_change(v(0), v(1))) == [150.0, None]


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0), (2, None)], "k int, x double")
    assert {r.k: r.s for r in df.groupBy("k").agg(N.strict_sum(F.col("x")).alias("s")).collect()} == {1: 3.0, 2: None}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<double>")
    assert [r[0] for r in df.select(N.normalized(F.col("v"))).collect()] == [[0.6, 0.8], None, None]


def test_search_order_filter_and_ties(spark):
    v = spark.createDataFrame([("A-2024-1A-0000", [1.0, 0.0]), ("A-2023-7-0000", [0.0, 1.0]), ("B", [1.0, 0.0])], "id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    rows = {r["rank"]: r.id for r in dense.search(v, q, 2).collect()}
    assert rows == {1: "A-2024-1A-0000", 2: "B"}
    assert dense.search(v, q.limit(0), 2).count() == 0


def test_fusion_scores_and_ties(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0)], "query_id long, id long, score double")
    for fuse in (fusion.fuse_global, fusion.fuse_candidates):
        rows = sorted((r["rank"], r.id, r.score) for r in fuse(d, b, 5).collect())
        assert [x[:2] for x in rows] == [(1, 1), (2, 2)] and rows[0][2] == rows[1][2] == round(1 / 61 + 1 / 62, 9)
    assert fusion.fuse_global(d.limit(0), b, 5).count() == 0


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "d"), (4, "e")], "id long, text string")
    q = spark.createDataFrame([(9, "c c z")], "query_id long, text string")
    rows = lexical.bm25(corpus, q).collect()
    idf = math.log(4 - 1 + 0.5) - math.log(1 + 0.5)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (1 - 0.75 + 0.75 * 3 / (7 / 4)))
    assert [(r.query_id, r.id) for r in rows] == [(9, 2)] and abs(rows[0].score - want) < 1e-6


def test_chunks(spark):
    s = spark.createDataFrame([(1, "ACME", 2024, "1A", "abcdefghij")], "doc_id long, ticker string, fiscal_year int, item string, texto string")
    rows = [(r.chunk_id, r.texto, r.inicio_car, r.fin_car) for r in chunking.character_windows(s, 6, 4).orderBy("posicion").collect()]
    assert rows == [("ACME-2024-1A-0000", "abcdef", 0, 6), ("ACME-2024-1A-0001", "efghij", 4, 10)]
    c = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 4, 6)], "doc_id long, posicion long, inicio_car long, fin_car long")
    assert [tuple(r) for r in chunking.gaps(c, s.select("doc_id", "texto")).collect()] == [(1, 2, 4)]


def test_numbers_in_prose(spark):
    said = "1.234,5 miles; 1,000.25 and 2.5 Billion, -3 and 12,5 MILLONES; FY2024 0,125 10 200 12mn 5 mil 1,2,3 1.2.3 , . 7. 3 mil millones 12 billones 1.234.567 0.5 1.000 .5 5 million"
    assert one(spark, N.prose_numbers(F.lit(said)), N.prose_numbers(F.lit("")), N.prose_numbers(F.lit(None).cast("string"))) == [[1234500.0, 1000.25, 2.5e9, 3.0, 12.5e6, 2024.0, 125.0, 10.0, 200.0, 12.0, 5.0, 12.3, 7.0, 3e9, 12e9, 1234567.0, 0.5, 1000.0, 5.0, 5e6], [], None]


def test_span_across_ellipses():
    text = "The “supply chain” was — as always — under pressure, and then demand fell sharply."
    assert udfs.span("the \"supply chain\" was - as … demand fell sharply", text) == text[:-1]
    assert udfs.span("short", text) is None and udfs.span("supply chain was never there at all", text) is None


def test_search_arguments():
    assert tools.checked(" q ", 5, " acme ", 2024, "1a") == {"query": "q", "k": 5, "ticker": "ACME", "fiscal_year": 2024, "item": "1A"}
    for bad in (("", 5), ("q", 0), ("q", True)):
        with pytest.raises(ValueError):
            tools.checked(*bad)


def test_signatures():
    assert signature({"b": 1, "a": [2]}) == signature({"a": [2], "b": 1}) != signature({"a": [1], "b": 1})
    assert sensitive_keys({"a": {"api_key": 1}, "l": [{"Password": 2}]}) == ["a.api_key", "l.0.Password"]


def test_detectors(spark):
    asked = ["¿Cómo evolucionó entre 2022 y FY 2023?", "FY2023 vs. 2022", "Variación 2022, 2023", "En 2022 y en 2023", "Ingresos 2023"]
    said = ["No está en el informe", "n/a", "fuera del corpus", "sin cambios", "5 millones"]
    failed = ["Status code: 429", "BadRequestResponseError: Provider returned error", "BadRequestResponseError", "timeout", None]
    df = spark.createDataFrame(list(zip(range(5), asked, said, failed, strict=True)), "i int, q string, s string, e string")
    rows = df.select(T.comparative(F.col("q")), T.no_answer(F.col("s")), T.transient_error(F.col("e"))).collect()
    assert [r[0] for r in rows] == [True, True, True, False, False]
    assert [r[1] for r in rows] == [True, True, True, False, False]
    assert [r[2] for r in rows] == [True, True, False, False, False]


def test_line_scores(spark):
    from quaestor.operators.evidence import scored_lines

    lines = [("Ventas netas de 123 millones", "Las ventas fueron 123"), ("uno dos tres cuatro cinco seis", "uno dos tres cuatro cinco ocho"), ("uno dos tres cuatro", "uno dos otra cosa"), ("sin nada", "ni 123")]
    lines.append(("creció un 1.234,5% neto", "el neto: 12345"))  # one number, by its digits
    out = {r.q: r.score for r in scored_lines(spark.createDataFrame(lines, "q string, l string"), "q", "l").collect()}
    assert out[lines[0][0]][:2] == (1, 1) and out[lines[1][0]].words == 5 and abs(out[lines[1][0]].coverage - 5 / 6) < 1e-9 and out[lines[4][0]][:2] == (1, 1) and len(out) == 3


def test_collection_problems(spark):
    from quaestor.operators import golden

    df = spark.createDataFrame([(1, "comparativa"), (1, "numerica"), (2, "extractiva")], "id int, familia string")
    assert sorted(tuple(r)[1] for r in golden.collection_problems(df, 4, 2).collect()) == ["comparatives 1 of 2", "count 3 of 4", "id_repeated"]
    assert golden.collection_problems(df.dropDuplicates(["id"]), 2).count() == 0


def test_blank_filters_are_refused():
    for bad in ({"ticker": " "}, {"item": ""}):
        with pytest.raises(ValueError):
            tools.checked("q", 5, **bad)
