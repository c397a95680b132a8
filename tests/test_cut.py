"""Chunks are cut in one pass over a text, not counted from its start for each; they stay plain windows of characters."""

from quaestor.plans import views as V


def test_chunks_are_windows_of_characters(spark, tmp_path):
    texts = [None, "", "x", "é" * 320, "é" * 399, "a😀\n\r " * 80, "b" * 401, "中\x00c" * 160, "d" * 721, "".join(chr(0x20 + i % 0x2FF) for i in range(5000))]
    rows = [(i, "s", t, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, p, t[p * 320 : p * 320 + 400]) for i, t in enumerate(texts) if t for p in range(max(len(t) - 81, 0) // 320 + 1)}
    cut = V.chunks(spark, str(tmp_path))
    found = cut.collect()
    assert {(r.doc_id, r.posicion, r.texto) for r in found} == want and len(found) == len(want)
    assert all(r.inicio_car == r.posicion * 320 and r.fin_car == r.inicio_car + len(r.texto) for r in found)
    plan = cut.select("texto")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "* 320) + 1" not in plan
