"""Round trips through files."""

import json

import pytest
from pyspark.sql import functions as F

from quaestor import schemas
from quaestor.functions import text
from quaestor.operators import chunking, manifest, tools
from quaestor.operators.tools import Evidence
from quaestor.sources import jsonl, tables
from quaestor.streaming.evaluation import score_stream

CHUNK = {"chunk_id": "ACME-2024-1A-0000", "ticker": "ACME", "fiscal_year": 2024, "item": "1A", "posicion": 0, "texto": "abc", "n_tokens": 1, "contiene_tabla": False, "inicio_car": 0, "fin_car": 3}


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_strict_lines(spark, tmp_path):
    other = CHUNK | {"chunk_id": "ACME-2024-1A-0001", "posicion": 1}
    assert jsonl.read_strict(spark, lines(tmp_path / "a.jsonl", CHUNK, "", other), schemas.CHUNK, "chunk_id").count() == 2
    with pytest.raises(ValueError, match="b.jsonl:2: not_json"):
        jsonl.read_strict(spark, lines(tmp_path / "b.jsonl", CHUNK, "{oops"), schemas.CHUNK)
    with pytest.raises(ValueError, match="missing:texto"):
        jsonl.read_strict(spark, lines(tmp_path / "c.jsonl", {k: v for k, v in CHUNK.items() if k != "texto"}), schemas.CHUNK)
    with pytest.raises(ValueError, match="unique"):
        jsonl.read_strict(spark, lines(tmp_path / "d.jsonl", CHUNK, CHUNK), schemas.CHUNK, "chunk_id")


def test_sections_have_unique_keys(spark, tmp_path):
    row = {"ticker": "ACME", "fiscal_year": 2024, "item": "1A", "texto": "x"}
    assert jsonl.read_sections(spark, lines(tmp_path / "a.jsonl", row)).count() == 1
    with pytest.raises(ValueError, match="keys"):
        jsonl.read_sections(spark, lines(tmp_path / "b.jsonl", row, row))


def test_sink_does_not_overwrite(spark, tmp_path):
    jsonl.write_new(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        jsonl.write_new(spark.range(3), str(tmp_path / "out"))


def test_results_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("a", True, None, None), ("b", False, 0.5, 0.01)], "id string, cita boolean, recall double, coste_usd double")
    tables.write_results(r, str(tmp_path / "r"))
    back = {x.id: x for x in tables.read_results(spark, str(tmp_path / "r")).collect()}
    assert back["a"].recall is None and back["a"].cita is True and back["a"].coste_usd == 0.0 and back["b"].coste_usd == 0.01


def test_vectors_have_one_dimension(spark, tmp_path):
    spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0])], "id string, vector array<float>").write.parquet(str(tmp_path / "v"))
    assert tables.read_vectors(spark, str(tmp_path / "v")).count() == 2
    with pytest.raises(ValueError):
        tables.read_vectors(spark, str(tmp_path / "v"), 2)


def test_progress_keeps_the_last(spark, tmp_path):
    for x, error in ((1, None), (2, None), (3, "HTTP 429")):
        tables.append_progress(spark.createDataFrame([("a", x, error)], "id string, x int, error string"), str(tmp_path / "p"))
    assert [(r.id, r.x) for r in tables.read_progress(spark, str(tmp_path / "p")).collect()] == [("a", 2)]


def variant(spark, path, chunker=None):
    s = spark.createDataFrame([(1, "ACME", 2024, "1A", "abcdefghij")], "doc_id long, ticker string, fiscal_year int, item string, texto string")
    return manifest.build_variant(s, path, chunker or (lambda x: chunking.character_windows(x, 6, 4)))


def test_variant_is_published_once_and_checked(spark, tmp_path):
    path = str(tmp_path / "v")
    assert variant(spark, path)["chunks"]["rows"] == 2
    assert manifest.open_variant(spark, path)["chunks"].count() == 2
    with pytest.raises(FileExistsError):
        variant(spark, path)
    spark.range(1).select(F.lit("x").alias("chunk_id")).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(ValueError):
        manifest.open_variant(spark, path)


def test_variant_with_gaps_leaves_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="lost"):
        variant(spark, str(tmp_path / "v"), lambda x: chunking.character_windows(x, 2, 2).where("posicion <> 1").withColumn("posicion", F.when(F.col("posicion") > 0, F.col("posicion") - 1).otherwise(0)))
    assert list(tmp_path.iterdir()) == []


def test_evidence_tools(spark):
    s = spark.createDataFrame([("ACME", 2024, "1A", "text one"), ("ACME", 2023, "7", "text two")], "ticker string, fiscal_year int, item string, texto string")
    f = spark.createDataFrame([("ACME", 2024, "NetIncomeLoss", 100.0, "USD")], "ticker string, fiscal_year int, concept string, value double, unit string")
    c = s.withColumn("chunk_id", F.concat_ws("-", "ticker", "fiscal_year", "item", F.lit("0000")))
    v = spark.createDataFrame([("ACME-2024-1A-0000", [1.0, 0.0]), ("ACME-2023-7-0000", [0.0, 1.0])], "id string, vector array<float>")
    e = Evidence(s, f, c, v, lambda q: q.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector")))
    q = spark.createDataFrame([(1, "supply")], "query_id long, text string")
    assert e.fact("ACME", 2024, "NetIncomeLoss").first().rendered == "NetIncomeLoss = 100 USD"
    assert e.section("ACME", 2024, "9B").first().texto == "not available"
    ids = lambda d: [r.id for r in d.orderBy("rank").collect()]
    assert ids(e.search(q, 2)) == ["ACME-2024-1A-0000", "ACME-2023-7-0000"]
    assert ids(e.search(q, 2, fiscal_year=2023)) == ["ACME-2023-7-0000"]
    assert ids(e.search(q, 1, flat=True, fiscal_year=2023)) == ["ACME-2024-1A-0000"]


def test_stream_scores_each_answer_once(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([("a", 1), ("b", 2)], [("a", 1), ("c", 3)]):
        spark.createDataFrame(part, "id string, x int").coalesce(1).write.mode("append").parquet(src)
        q = score_stream(spark, src, spark.read.parquet(src).schema, lambda d: d.withColumn("hit", F.col("x") > 1), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.hit) for r in out.collect()) == [("a", False), ("b", True), ("c", True)]


def test_audit_and_report_sinks(spark, tmp_path):
    found = spark.createDataFrame([("a", "cita", None), ("b", "cifra", 2.5)], "id string, regla string, valor double")
    assert tables.write_audit(found.limit(0), str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()
    assert tables.write_audit(found, str(tmp_path / "audit")) == 2
    tables.write_report(found, str(tmp_path / "report"))
    want = {"a": ("cita", None), "b": ("cifra", 2.5)}
    for back in (spark.read.json(str(tmp_path / "audit")), spark.read.json(str(tmp_path / "report/json")), spark.read.csv(str(tmp_path / "report/csv"), header=True)):
        assert {r.id: (r.regla, None if r.valor is None else float(r.valor)) for r in back.collect()} == want


def test_corpus_is_the_first_folder_that_has_its_file(spark, tmp_path):
    folders = [tmp_path / x for x in "abc"]
    for f in folders[1:]:
        f.mkdir()
        (f / "chunks.jsonl").write_text("{}")
    assert tables.find_corpus(spark, [str(f) for f in folders]) == str(folders[1])
    with pytest.raises(FileNotFoundError, match="chunks.jsonl"):
        tables.find_corpus(spark, [str(folders[0])])


def test_tools_keep_their_contract():
    good = {n: {"properties": dict.fromkeys(a, {}), "required": sorted(r)} for n, (a, r) in tools.CONTRACT.items()}
    assert tools.contract_problems(good) == []
    bad = {n: s for n, s in good.items() if n != "read_section"} | {"other": {}, "search_filings": good["search_filings"] | {"required": ["k", "query"]}}
    assert tools.contract_problems(bad) == ["read_section: missing", "other: unknown", "search_filings: required ['k', 'query'], not ['query']"]


def test_times_need_an_offset(spark):
    said = ["2024-05-06T07:08:09Z", "2024-05-06T07:08:09.5+02:00", "2024-05-06T07:08:09", "2024-05-06", "x:00:00Z", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", F.unix_timestamp(text.zoned_time(F.col("t"))).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {0: 1714979289, 1: 1714972089, 2: None, 3: None, 4: None, 5: None, 6: None}
