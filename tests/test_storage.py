"""Exact percentiles, places, order-sensitive digests, plugged-in cutters, versions and caches."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.operators import chunking, positions, quantiles
from quaestor.sources import tables, versions


@pytest.mark.parametrize("sizes", [(512, 5000), (3, 1), (2, 4)])
def test_exact_percentiles(spark, monkeypatch, sizes):
    monkeypatch.setattr(quantiles, "BINS", sizes[0])
    monkeypatch.setattr(quantiles, "FEW", sizes[1])
    rng = random.Random(2)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(400)], "ties": [5.0] * 60 + [1.0] * 30, "one": [3.5], "wide": [1.7e308, -1.7e308, 0.0, 5e-324, 1.0], "steep": [10.0**i for i in range(-20, 20)], None: [1.0, 2.0, 2.0, 9.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("hot", None), ("hot", float("nan")), ("ties", float("inf")), ("none", None)]
    out = quantiles.exact_percentiles(spark.createDataFrame(rows, "k string, x double").repartition(5), ["k"], "x", [0.5, 0.95, 0, 1, 0.5])
    have = {(r.k, r.share): r.percentile for r in out.collect()}
    want = {(k, q): float(np.percentile(xs, 100 * q)) for k, xs in groups.items() if k != "wide" for q in (0, 0.5, 0.95, 1)}
    assert {k: v for k, v in have.items() if k[0] != "wide"} == pytest.approx(want, rel=1e-12)
    assert [have["wide", q] for q in (0, 0.5, 1)] == [-1.7e308, 5e-324, 1.7e308] and len(have) == 24
    with pytest.raises(ValueError):
        quantiles.exact_percentiles(out, ["k"], "percentile", [1.5])


def test_positions_and_joins_by_them(spark, tmp_path):
    rows = [(f"c{i:04}", [float(i), 1.0]) for i in range(1000)]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    df.select("vector").coalesce(1).write.parquet(f"{tmp_path}/v1")
    df.select("chunk_id").orderBy("chunk_id").repartitionByRange(7, "chunk_id").sortWithinPartitions("chunk_id").write.parquet(f"{tmp_path}/m7")
    one, seven = positions.positions(spark, f"{tmp_path}/v1"), positions.positions(spark, f"{tmp_path}/m7")
    assert sorted(r.position for r in seven.collect()) == list(range(1000))
    stored_order = {r.position: int(r.vector[0]) for r in one.collect()}
    joined = positions.join_by_position(seven, one)
    assert all(int(r.chunk_id[1:]) == r.position and int(r.vector[0]) == stored_order[r.position] for r in joined.collect())
    chunks = df.select("chunk_id", F.substring("chunk_id", 2, 4).cast("long").alias("position"))
    assert positions.check_index(spark, f"{tmp_path}/v1", f"{tmp_path}/m7", chunks, 2) == []
    swapped = chunks.withColumn("position", F.when(F.col("position") == 5, 6).when(F.col("position") == 6, 5).otherwise(F.col("position")))
    assert positions.check_index(spark, f"{tmp_path}/v1", f"{tmp_path}/m7", swapped, 3) == ["not all vectors have 3 components", "another chunk at 5, 6"]
    assert positions.check_index(spark, f"{tmp_path}/v1", f"{tmp_path}/m7", chunks.where("position < 998"), 2) == ["1000 vectors, 1000 metadata rows, 998 chunks", "another chunk at 998, 999"]
    with pytest.raises(ValueError, match="1000 rows against 999"):
        positions.join_by_position(one, seven.where("position > 0"))


def test_digest_trees_hang_on_order_and_content_alone(spark):
    rows = [(g, i * 3, f"text {g} {i}") for g in "ab" for i in range(200)]
    tree = lambda data, parts=3: {r.g: r.fingerprint for r in positions.digest_tree(spark.createDataFrame(data, "g string, at long, t string").repartition(parts), "at", F.col("t"), ["g"], 10, 3).collect()}
    first = tree(rows)
    assert tree(rows[::-1], 7) == first and first["a"] != first["b"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = {i * 3: sha(f"text a {i}") for i in range(200)}
    for _ in range(3):
        up = {}
        for at in sorted(level):
            up.setdefault(at // 10, []).append(level[at])
        level = {at: sha("".join(x)) for at, x in up.items()}
    assert level == {0: first["a"]}
    changed = [(g, i, t + "!" if (g, i) == ("a", 300) else t) for g, i, t in rows]
    moved = [(g, {300: 303, 303: 300}.get(i, i) if g == "a" else i, t) for g, i, t in rows]
    for other in (changed, moved, rows[1:]):
        assert tree(other)["a"] != first["a"] and tree(other)["b"] == first["b"]
    with pytest.raises(Exception, match="a place isn't from 0 to 999"):
        tree([*rows, ("a", 1000, "x")])


def cutters():
    """Functions of a function, which travel to workers by value."""

    def sentences(text):
        ends = [i + 1 for i, c in enumerate(text) if c == "."]
        if text[ends[-1] if ends else 0 :].strip():
            ends.append(len(text))
        return zip([0, *ends], ends, strict=False)

    def windows(text, size=7, step=5):
        return [(i, min(len(text), i + size)) for i in range(0, max(1, len(text) - (size - step)), step)] if text.strip() else []

    return sentences, windows


def test_two_cutters_and_bad_ones(spark):
    texts = ["One. Two is longer. Three", "Ünï 🙂 code. points", "", "   ", None, "no stop"]
    s = spark.createDataFrame([(i, f"T{i}", 2024, "1A", t) for i, t in enumerate(texts)], "doc_id long, ticker string, fiscal_year int, item string, texto string")
    for cutter in cutters():
        c = chunking.cut_by(s, cutter).persist()
        have = {i: [(r.inicio_car, r.fin_car, r.texto) for r in sorted((r for r in c.collect() if r.doc_id == i), key=lambda r: r.posicion)] for i in range(len(texts))}
        assert have == {i: [(a, b, (t or "")[a:b]) for a, b in cutter(t or "")] for i, t in enumerate(texts)} and have[0]
        v = chunking.validate(c, s.select("doc_id", "texto")).where("NOT (in_order AND unique_spans AND in_bounds)").count()
        assert v == 0 and c.where("chunk_id = 'T0-2024-1A-0001'").count() == 1 and chunking.gaps(c, s.select("doc_id", "texto")).count() == 0
    bad = {"in no cut": lambda t: [(0, 1)], "inside": lambda t: [(0, len(t) + 1)], "before": lambda t: [(0, 5), (4, 7), (2, 6)], "twice": lambda t: [(0, len(t))] * 2 if t else [], "no cuts": lambda t: []}
    for what, cutter in bad.items():
        with pytest.raises(Exception, match=what):
            chunking.cut_by(s.where("doc_id = 5"), cutter).collect()
    with pytest.raises(TypeError, match="one text"):
        chunking.cut_by(s, lambda a, b: [])
    with pytest.raises(TypeError, match="one text"):
        chunking.cut_by(s, lambda: [])


def test_versions_are_replaced_by_one_rename(spark, tmp_path):
    path = str(tmp_path / "t")
    numbers = lambda: sorted(r.id for r in versions.read(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    versions.replace(spark.range(3), path)
    assert numbers() == [0, 1, 2]
    dead = versions.write_version(spark.range(9), path)  # a writer that dies before it renames
    assert numbers() == [0, 1, 2]
    other = versions.write_version(spark.range(5), path)  # two writers: the last to rename wins
    versions.point_to(spark, path, dead)
    assert len(numbers()) == 9
    versions.point_to(spark, path, other)
    assert len(numbers()) == 5 and versions.current(spark, path) == other
    os.makedirs(f"{path}/.CURRENT-half")  # what a crash amid a pointer's writing leaves
    assert len(numbers()) == 5 and not [f for f in os.listdir(path) if f.startswith(".CURRENT-") and "half" not in f]


def test_caches_keep_what_came_first(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    versions.insert_absent(rows(("a", "2"), ("a", "1"), ("b", "x")), path, "k", "v")
    out = versions.insert_absent(rows(("a", "0"), ("c", "y"), (None, "n")), path, "k", "v")
    assert {tuple(r) for r in out.collect()} == {("a", "1"), ("b", "x"), ("c", "y"), (None, "n")}
    asked = []

    def rewriter(q):
        asked.append(sorted(r.text for r in q.collect()))
        return q.select("query_id", F.when(F.col("text") != "bad", F.upper("text")).alias("text"))

    q = lambda *r: spark.createDataFrame(list(enumerate(r)), "query_id long, text string")
    at = str(tmp_path / "r")
    first = {r.query_id: r.text for r in versions.cached_rewrites(q("one", "two", "bad", "one", None), at, rewriter).collect()}
    again = {r.query_id: r.text for r in versions.cached_rewrites(q("two", "three"), at, rewriter).collect()}
    assert first == {0: "ONE", 1: "TWO", 2: "bad", 3: "ONE", 4: None} and again == {0: "TWO", 1: "THREE"}
    assert asked == [["bad", "one", "one", "two"], ["three"]]


@pytest.mark.parametrize("whole", [0, 100, 1 << 20])
def test_digests_of_files_read_whole_or_in_blocks(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(tables, "WHOLE", whole)
    files = {"a.bin": b"", "b.gz": b"not packed" * 3, "sub/c é.txt": bytes(range(256)) * 900, "d": b"x" * 100}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    out = {r.name: (r.bytes, r.sha256) for r in tables.file_hashes(spark, str(tmp_path)).collect()}
    assert out == {name.split("/")[-1]: (len(c), hashlib.sha256(c).hexdigest()) for name, c in files.items() if c}
