"""The pipeline on the smallest tables, each stage held against what plain Python says of its input."""

from collections import Counter

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES

from quaestor.llm import minhash, zstd_quality
from quaestor.llm.common import documents, store

DIR = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs, seen = store(documents(spark, DIR), "t"), []
    for name, stage in STAGES:
        out = store(stage(spark, docs, DIR), "t")
        seen.append((docs.toPandas(), out.toPandas()))
        if stage is not STAGES[-1][1]:
            assert out.columns == COLUMNS, name
        docs = out
    (all_, good), (_, single), (_, cut), (_, mixed), (_, tokens) = seen
    model = zstd_quality.train(documents(spark, DIR), spark.read.parquet(f"{DIR}/labels.parquet"))
    verdict = zstd_quality.score(documents(spark, DIR), model).toPandas().set_index("doc_id").predicted
    assert set(good.doc_id) == {i for i in all_.doc_id if verdict[i] == 1} and len(good) > 150
    sets = {i: minhash._set(t, 5) for i, t in zip(good.doc_id, good.text, strict=True)}
    alike = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    kept = sorted(single.doc_id)
    assert not any(alike(sets[a], sets[b]) for a in kept for b in kept if a < b)
    assert all(any(alike(sets[i], sets[j]) for j in sets if j != i) for i in set(sets) - set(kept))
    before = dict(zip(single.doc_id, single.text, strict=True))
    seen_windows = {}
    for i in sorted(before):
        w = before[i].split()
        for k in range(len(w) - 49):
            seen_windows.setdefault(tuple(w[k : k + 50]), i)
    for i, t in zip(cut.doc_id, cut.text, strict=True):
        assert len(t) <= len(before[i])
        w = t.split()
        assert all(seen_windows[x] == i for k in range(len(w) - 63) if (x := tuple(w[k : k + 50])) in seen_windows and tuple(w[k + 14 : k + 64]) in seen_windows and seen_windows[tuple(w[k + 14 : k + 64])] != i)
    assert abs(mixed.text.map(lambda t: len(t.split())).sum() / cut.text.map(lambda t: len(t.encode().split())).sum() - 1) < 0.02
    assert tokens.round_trip.all() and len(tokens) == len(mixed) and (tokens.n_tokens == tokens.ids.map(len)).all()


def test_stages_on_odd_rows(spark, crowded, rows, tmp_path):
    """Nulls in each column, empty and long texts, repeated rows and ids, clashing names, as input of each stage by itself."""
    labels = [(i, int(i % 4 != 0)) for i in range(65)] + [(None, 1), (3, None), (5, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    words = lambda t: (t or "").encode().split()
    out = {name: stage(spark, crowded, str(tmp_path)).toPandas() for name, stage in STAGES}
    for name, _ in STAGES[:-1]:
        assert list(out[name].columns) == COLUMNS
    model = zstd_quality.train(crowded, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = zstd_quality.score(crowded.select(*COLUMNS), model).where("predicted = 1").toPandas()
    pairs = lambda frame: sorted(((i, t) for i, t in zip(frame.doc_id.astype("Int64").astype(object).where(frame.doc_id.notna(), None), frame.text, strict=True)), key=str)
    assert pairs(out["quality classifier"]) == pairs(good)
    single = out["MinHash near-dedup"]
    assert single.doc_id.notna().sum() == single.doc_id.nunique() and single.doc_id.isna().sum() == sum(r[0] is None for r in rows)
    assert {54, 55, 56, 57, 58} <= set(single.doc_id.dropna().astype(int)) and 52 not in set(single.doc_id) and sum(40 <= i < 52 for i in single.doc_id) < 12
    cut = out["substring dedup"]
    lost = Counter(map(str, (t for _, t, *_ in rows))) - Counter(map(str, cut.text))
    assert len(cut) <= len(rows) and all(len(words(t)) >= 50 for t in lost if t not in ("None", "")) and cut.text.isna().sum() == 1
    assert all(n == len(t) for n, t, i in zip(cut.n_chars, cut.text, cut.doc_id, strict=True) if i == 61) and not cut[cut.doc_id == 61].text.str.contains(" ".join(rows[-4][1].split()[100:130]), regex=False).any()
    mixed = out["mixing sources to target weights"]
    times = Counter(int(i) for i in mixed.doc_id.dropna())
    whole = {}
    for i, t, *_ in rows:
        whole[i] = whole.get(i, 0) + len(words(t))
    assert len(mixed) and mixed.columns.tolist() == COLUMNS and all(sum(len(words(t)) for t in mixed[mixed.doc_id == i].text) <= 3 * whole[i] for i in times)
    tokens = out["byte-level BPE"]
    assert len(tokens) == len(rows) and tokens.round_trip.all() and sorted(tokens.n_tokens)[0] == 0


def test_an_empty_table(spark, empty):
    docs = empty
    for _, stage in STAGES:
        docs = store(stage(spark, docs, DIR), "t")
        assert docs.count() == 0


def test_no_sql(spark):
    assert corpus_pipeline.ORACLE_SQL is None
