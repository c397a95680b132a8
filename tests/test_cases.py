"""Cases against their corpus, the loader, scored numbers, evidence, encoders and rewriters, on inputs that reach each branch."""

import json

import pytest

from quaestor.operators import chunking, dense, evidence, golden, manifest, tools, traces

SECTIONS = [("AB", 2024, "1A", "The anchor stands here."), ("AB", 2024, "7", "one"), ("AB", 2024, "7", "two"), ("CD", 2023, "8", "x")]
FACTS = [("AB", 2024, "Revenue", 5.0, "USD")]
BASE = {"id": "c", "pregunta": "¿?", "familia": "extractiva", "ticker": " ab ", "fiscal_year": 2024, "respuesta_esperada": "r", "item_esperado": "1A", "ancla_texto": "anchor stands", "ancla_inicio": 4, "ancla_fin": 17, "herramienta_esperada": ["search_filings"]}
NUMBER = {"id": "n", "pregunta": "¿?", "familia": "numerica", "ticker": "AB", "fiscal_year": 2024, "respuesta_esperada": "r", "concept_xbrl": "Revenue", "cifra_esperada": 5.0, "unidad": "USD"}


def corpus(spark):
    return spark.createDataFrame(SECTIONS, "ticker string, fiscal_year int, item string, texto string"), spark.createDataFrame(FACTS, "ticker string, fiscal_year int, concept string, value double, unit string")


def load(spark, path, cases, *more):
    path.write_text("\n".join(c if isinstance(c, str) else json.dumps(c) for c in cases) + "\n")
    return golden.load_cases(spark, str(path), *corpus(spark), *more)


def test_cases_are_loaded_all_or_none(spark, tmp_path):
    absent = NUMBER | {"id": "a", "concept_xbrl": "Nothing", "cifra_esperada": None, "unidad": None}
    out = {r.id: r for r in load(spark, tmp_path / "good.jsonl", [BASE | {"unidad": "  "}, "", NUMBER, absent, absent | {"id": "b", "ticker": "ZZ"}], 4).collect()}
    assert out["c"].ticker == "AB" and out["c"].unidad is None and out["c"].ancla_texto == "anchor stands" and len(out) == 4
    bad = {
        "n: fact_missing": [NUMBER | {"concept_xbrl": "Other"}], "a: fact_present": [absent | {"concept_xbrl": "Revenue"}], "n: document_missing": [NUMBER | {"ticker": "ZZ"}], "c: sections 2": [BASE | {"item_esperado": "7"}], "c: sections 0": [BASE | {"item_esperado": "9"}],
        "c: offsets_wrong": [BASE | {"ancla_texto": "anchor stood!"}], "c: anchor_span": [BASE | {"ancla_fin": 18}], "c: id_repeated": [BASE, BASE], "count 1 of 3": [BASE], "comparatives 0 of 1": [BASE], "not_json": [BASE, "{"], "missing:familia": [{"id": "x"}], "c: blank:pregunta": [BASE | {"pregunta": " "}],
    }
    for i, (what, cases) in enumerate(bad.items()):
        more = (3,) if "count" in what else (None, 1) if "comparatives" in what else ()
        with pytest.raises(ValueError, match=what.replace(".", "[.]")):
            load(spark, tmp_path / f"{i}.jsonl", cases, *more)


def test_a_missing_document_is_all_that_is_said(spark):
    case = "id string, familia string, ticker string, fiscal_year int, concept_xbrl string, cifra_esperada double, unidad string, item_esperado string, ancla_texto string, ancla_inicio int, ancla_fin int"
    rows = [("1", "comparativa", "ZZ", 2024, "Revenue", 1.0, "USD", "1A", "x", 0, 1), ("2", "comparativa", "AB", 2024, "Other", 1.0, "USD", "7", "x", 0, 1), ("3", "comparativa", "AB", 2024, "Revenue", None, None, "1A", "The", 0, 3), ("4", "numerica", "CD", 2023, "Revenue", None, None, None, None, None, None)]
    out = sorted(tuple(r) for r in golden.corpus_problems(spark.createDataFrame(rows, case), *corpus(spark)).collect())
    assert out == [("1", "document_missing"), ("2", "fact_missing"), ("2", "sections 2")]


def test_numbers_and_abstentions(spark):
    rows = {
        ("numerica", None, None, None, "ninguna", None, None): True, ("numerica", None, None, "failed", "ninguna", None, None): False, ("numerica", None, None, None, "texto", None, None): False, ("numerica", None, None, None, "ninguna", 1.0, None): False, ("numerica", None, None, None, "ninguna", None, "USD"): False, ("numerica", None, None, None, None, None, None): False,
        ("numerica", 100.0, "USD", "failed", "xbrl", 101.0, " usd"): True, ("comparativa", 100.0, "USD", None, "xbrl", 102.0, "USD"): False, ("comparativa", 100.0, "USD", None, "xbrl", 100.0, "EUR"): False, ("comparativa", 100.0, "USD", None, "xbrl", 100.0, None): False, ("comparativa", 100.0, None, None, "xbrl", 100.0, "USD"): False,
        ("comparativa", None, None, None, "ninguna", None, None): False, ("numerica", 100.0, "USD", None, "xbrl", float("inf"), "USD"): False, ("numerica", 100.0, "straße", None, "xbrl", 100.0, "STRASSE"): True, ("extractiva", None, None, None, "texto", None, None): None,
    }
    df = spark.createDataFrame([(*k, i) for i, k in enumerate(rows)], "familia string, cifra_esperada double, unidad string, error string, fuente string, cifra double, unidad_dicha string, i int")
    assert {r.i: r.cifra_correcta for r in golden.number_scored(df).collect()} == dict(enumerate(rows.values()))


def test_evidence_that_is_not_accepted(spark):
    chunks = spark.createDataFrame([("AB-2024-1A-0000", "AB", 2024, "The anchor stands here."), ("CD-2023-8-0000", "CD", 2023, "x")], "chunk_id string, ticker string, fiscal_year int, texto string")
    a, b = "AB-2024-1A-0000", "CD-2023-8-0000"
    said = {  # ticker, year, source, quote, chunk, number, unit: errors
        "fine": ("AB", 2024, "texto", "anchor stands", a, None, None, []), "silent": (None, None, "ninguna", None, None, None, None, []), "case": ("AB", 2024, "texto", "Anchor", a, None, None, ["not_literal"]), "no chunk": ("AB", 2024, "ambas", "anchor", None, None, None, ["not_literal", "not_retrieved"]),
        "not searched": ("CD", 2023, "texto", "x", b, None, None, ["not_retrieved"]), "other year": ("AB", 2023, "texto", "anchor", a, None, None, ["identity"]), "no company": (None, 2024, "texto", "anchor", a, None, None, ["identity"]), "quote alone": ("AB", 2024, "xbrl", "anchor", None, 5.0, "USD", ["not_literal", "not_retrieved"]),
        "number": ("AB", 2024, "xbrl", None, None, 5.000001, "USD", []), "other number": ("AB", 2024, "xbrl", None, None, 5.1, "USD", ["number"]), "other unit": ("AB", 2024, "ambas", "anchor", a, 5.0, "EUR", ["number"]), "other place": ("AB", 2023, "xbrl", None, None, 5.0, "USD", ["number"]), "from text": ("AB", 2024, "texto", "anchor", a, 99.0, "USD", []),
    }
    rows = []
    for t in said:
        base = {"content": None, "calls": None, "invalid_args": None, "call_id": None, "name": None, "status": None, "duration_ms": None, "tokens_in": None, "tokens_out": None, "cost": None}
        rows += [(t, 1, "assistant", *(base | {"calls": [("s", "search_filings", "{}")]}).values()), (t, 2, "tool", *(base | {"call_id": "s", "content": f"[{a}] AB\ntext", "status": "success"}).values())]
    of = traces.calls(traces.threads(spark.createDataFrame(rows, traces.MESSAGE)))
    answers = spark.createDataFrame([(t, *x[:7]) for t, x in said.items()], "thread_id string, ticker string, ejercicio int, fuente string, cita string, chunk_id string, cifra double, unidad string")
    consulted = spark.createDataFrame([(t, "AB", 2024, 5.0, "USD") for t in said] * 2, "thread_id string, ticker string, fiscal_year int, value double, unit string")
    out = {r.thread_id: r.errors for r in evidence.evidence_errors(answers, of, consulted, chunks).collect()}
    assert out == {t: x[7] for t, x in said.items()}


def test_encoders_are_held_to_their_contract(spark):
    q = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, text string")
    seen = []

    def encoder(vectors):
        def encode(df):
            seen.append([r.text for r in df.orderBy("query_id").collect()])
            return spark.createDataFrame([(i, v) for i, v in vectors], "query_id long, vector array<double>")

        return encode

    good = tools.encoded(q, encoder([(1, [3.0, 4.0]), (2, [0.0, 2.0])]), "query: ", 2)
    assert {r.query_id: [round(x, 6) for x in r.vector] for r in good.collect()} == {1: [0.6, 0.8], 2: [0.0, 1.0]} and dict(good.dtypes)["vector"] == "array<float>"
    assert seen == [["query: one", "query: two"]]
    for wrong in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [0.0, 0.0]), (2, [1.0, 2.0])], [(1, [float("nan"), 1.0]), (2, [1.0, 2.0])], [(1, None), (2, [1.0, 2.0])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError, match="encoder"):
            tools.encoded(q, encoder(wrong), "", 2)
    assert dense.search(spark.createDataFrame([(7, [1.0, 0.0])], "id long, vector array<float>"), good, 1).count() == 2


def test_rewrites_fall_back_one_by_one(spark):
    def rewrite(text):
        if text == "fails":
            raise RuntimeError("no model")
        return {"empty": " "}.get(text, f" {text} in English ")

    q = spark.createDataFrame([(1, "good "), (2, "fails"), (3, "empty"), (4, " "), (5, "fails"), (6, None)], "query_id long, text string")
    recorded = spark.createDataFrame([(5, "kept"), (1, "unused")], "query_id long, text string")
    out = {r.query_id: (r.text, r.error) for r in tools.rewritten(q, rewrite, recorded).collect()}
    assert out == {1: ("good in English", None), 2: ("fails", "RuntimeError: no model"), 3: ("empty", "ValueError: an empty rewrite"), 4: (" ", None), 5: ("kept", "RuntimeError: no model"), 6: (None, None)}
    assert {r.query_id: r.text for r in tools.rewritten(q, rewrite).collect()}[5] == "fails"


def test_a_variant_keeps_to_its_folder():
    manifest.check_paths({"chunks": {"path": "chunks"}, "vectors": {"path": "v/1"}})
    for wrong in ({"chunks": {"path": "/x"}}, {"chunks": {"path": "../x"}}, {"chunks": {"path": "a/../../x"}}, {"chunks": {"path": "s3://x/y"}}, {"chunks": {"path": "."}}, {"chunks": {"path": "x"}, "vectors": {"path": "./x"}}, {"chunks": {"path": "x"}, "vectors": {"path": "x/y"}}):
        with pytest.raises(ValueError):
            manifest.check_paths(wrong)


def test_a_variant_can_be_moved(spark, tmp_path):
    """Its manifest's paths are relative to its folder."""
    s = spark.createDataFrame([(1, "AB", 2024, "1A", "some words that are cut here")], "doc_id long, ticker string, fiscal_year int, item string, texto string")
    manifest.build_variant(s, str(tmp_path / "a"), lambda x: chunking.character_windows(x, 10, 8))
    (tmp_path / "a").rename(tmp_path / "elsewhere")
    assert manifest.open_variant(spark, str(tmp_path / "elsewhere"))["chunks"].count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        manifest.open_variant(spark, str(tmp_path / "a"))
