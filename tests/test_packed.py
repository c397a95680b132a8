"""What a search shuffles of its postings: packed numbers, and of a part's blocks the k best of each query alone."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaestor.operators import lexical


@pytest.mark.parametrize("values", [[], [0], [255], [256, 0, 65_535], [65_536, 1, 4_000_000_000], list(range(3000))])
def test_packed_numbers_come_back(values):
    assert lexical.unpacked(pa.py_buffer(lexical.packed(np.array(values, dtype=np.int64)))).tolist() == values


def test_postings_take_two_bytes_at_most(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(60))) for i in range(2000)]
    of = lexical.blocks(spark.createDataFrame(rows, "id long, text string").coalesce(1), 4).where("bucket >= 0")
    held, n = of.agg(F.sum(F.length("doc") + F.length("tf")), F.sum(F.aggregate("df", F.lit(0), lambda a, x: a + x))).first()
    assert 0 < held < 2 * n


def test_a_part_passes_on_the_best_of_all_its_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "HEIGHT", 5)
    monkeypatch.setattr(lexical, "PARTS", 1)
    rows = [(i, "cost " * (1 + i % 7) + f"w{i}") for i in range(200)]
    index = lexical.build(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i"), 4)
    q = spark.createDataFrame([(1, "cost"), (2, "w7 cost")], "query_id long, text string")
    found = index._kept(q, lexical._best, k=3).collect()
    best = sorted(index.search(q).collect(), key=lambda r: (r.query_id, -r.score, r.id))
    assert sorted(map(tuple, found), key=lambda r: (r[0], -r[2], r[1])) == [tuple(r) for n in (1, 2) for r in [b for b in best if b.query_id == n][:3]]
