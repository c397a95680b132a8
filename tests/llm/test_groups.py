"""Near duplicates, passages, mixing, shards, vectors and the pipeline, against brute force."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from quaestor.llm import common, cross_polytope, kdtree, minhash, mixing, passages


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def split(text):
    return (text or "").encode().split()


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    out = {r.id: r.component_id for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert out == components({x for e in real for x in e}, real)


def test_minhash_greatest_text_of_an_id(spark):
    rng = random.Random(8)
    a, b = "a " + prose(rng, 60), "b " + prose(rng, 60)
    data = [(1, a), (1, b), (2, a), (3, b), (4, None), (4, b + " end"), (5, "z"), (5, a), (1, a), (None, a), (None, b)]
    found = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 2, 80).collect()
    want = {1: (60, 1), 2: (60, 2), 3: (60, 1), 4: (61, 1), 5: (1, 5)}
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id) == Counter((i, *want[i]) for i, _ in data if i)
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)] * 2


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_equals_brute_force(crowded, rows, empty, size):
    out = minhash.near_duplicates(crowded, size, 80).toPandas()
    assert len(out) == len(rows)
    sets = {}
    for i, t, *_ in rows:
        w = [x.lower() for x in split(t)]
        sets[i] = set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 20
    want = components(ids, links)
    have = out[out.doc_id.notna()]
    assert dict(zip(have.doc_id.astype(int), have.component_id.astype(int), strict=True)) == want
    assert dict(zip(have.doc_id.astype(int), have.n_shingles, strict=True)) == {i: len(sets[i]) for i in ids}
    assert (have.kept == (have.doc_id == have.component_id)).all() and out[out.doc_id.isna()].kept.all()
    assert minhash.near_duplicates(empty, size).count() == 0


def test_signature_agreement_is_similarity():
    rng = np.random.default_rng(0)
    for n, common_ in ((40, 30), (2000, 1500)):
        agree = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[:common_], rng.integers(0, 2**63, n - common_, dtype=np.uint64)])
            agree.append((minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).mean())
        assert abs(np.mean(agree) - common_ / (2 * n - common_)) < 0.04


def test_compact_windows_give_all_minima():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 120).astype(np.uint64)
    w = passages.compact_windows(v, 10)
    for i in range(len(v)):
        for j in range(i + 9, len(v)):
            holding = [c for left, c, right in w if left <= i <= c <= j <= right]
            assert len(holding) == 1 and v[holding[0]] == v[i : j + 1].min()


def test_passages_find_every_exact_repeat(spark, empty):
    rng = random.Random(8)
    shared = [prose(rng, 60), prose(rng, 51), prose(rng, 300)]
    data = []
    for i in range(60):
        body = [prose(rng, rng.randint(0, 80))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            body += [s, prose(rng, rng.randint(0, 60))]
        data.append((i, "\n".join(body)))
    longest = max(data, key=lambda d: len(d[1]))[1]
    data += [(60, longest), (61, None), (62, ""), (None, longest), (63, prose(rng, 5000)), (63, prose(rng, 49)), (64, ("same words again " * 60))]
    data.append((65, shared[2].replace(shared[2].split()[140], "changed", 1)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = passages.repeated_passages(df.selectExpr("*", "'x' AS key", "'y' AS hash", "'z' AS spans")).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).update(range(r.word_from, r.word_to))
    first, need = {}, {}
    for i, t in sorted((d for d in data if d[0] is not None), key=lambda d: d[0]):
        w = split(t)
        for k in range(len(w) - 49):
            f = first.setdefault(tuple(w[k : k + 50]), i)
            if f != i:
                need.setdefault(i, set()).update(range(k, k + 50))
    for i, places in need.items():
        assert len(places - got.get(i, set())) <= 14 * 6, i
    texts = {i: split(t) for i, t in data if i is not None and i != 63}
    assert set(got) <= set(need) | {65} and 64 not in got and 65 in got
    for r in out:
        a, b = texts[r.doc_id][r.word_from : r.word_to], texts[r.first_doc_id][r.first_from : r.first_from + r.n_words]
        assert a[:24] == b[:24] and r.first_doc_id < r.doc_id and r.first_doc_id in r.earlier_doc_ids
    assert passages.repeated_passages(empty).count() == 0
    kept = {r.doc_id: r.text or "" for r in passages.without_repeats(df.where("doc_id <> 63")).collect()}
    assert 60 not in kept and kept[0] == data[0][1] and not any(shared[0] in kept[i] and i > min(j for j in kept if shared[0] in kept[j]) for i in kept)


@pytest.mark.parametrize("n_words", [50, 60, 80, 200])
def test_changed_passages_are_found(spark, n_words):
    """Of passages with changed words, at a similarity of 0.8 or more by brute force, nine of ten are reported or more."""
    rng = random.Random(n_words)
    data, alike = [], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(150):
        own = prose(rng, n_words).split()
        changed = list(own)
        for at in rng.sample(range(n_words), rng.randint(1, 1 + n_words // 60)):
            changed[at : at + 1] = rng.choice(([prose(rng, 1)], [], [own[at], prose(rng, 1)]))
        a, b = shingles(own), shingles(changed)
        if len(changed) >= 50 and len(a & b) >= 0.8 * len(a | b):
            alike.append(2 * i + 1)
        data += [(2 * i + k, " ".join((prose(rng, 60), " ".join(x), prose(rng, 60)))) for k, x in enumerate((own, changed))]
    out = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = {r.doc_id for r in out if r.first_doc_id == r.doc_id - 1 and r.word_from < 60 + n_words and r.word_to > 60}
    print(n_words, len(alike), len(got & set(alike)))
    assert len(alike) > 60 and len(got & set(alike)) >= 0.9 * len(alike)
    assert all(r.doc_id % 2 for r in out)


def test_windows_of_one_word_repeated():
    began = time.process_time()
    w = passages.compact_windows(np.zeros(500_000, dtype=np.uint64))
    assert len(w) == 500_000 - passages.WINDOW + 1 and (w[:, 2] == 499_999).all() and time.process_time() - began < 5
    cycle = passages.compact_windows(np.tile(np.arange(100, dtype=np.uint64), 3000))
    assert time.process_time() - began < 10 and len(cycle) < 300_000


def test_cut_keeps_the_rest():
    assert passages._cut("a b\nc  d e", [(1, 3)]) == "a  d e" and passages._cut(" a b", [(0, 2)]) == ""


def targets(sizes):
    """By reshares, one after another."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left, w = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        t = {s: 3 * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def test_mixing(crowded, rows, empty):
    out = mixing.taken(crowded, block=16, shard=50).toPandas()
    assert len(out) == len(rows) and mixing.taken(empty).count() == 0
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(split(t))
    want = targets(dict(sizes))
    for s, size in sizes.items():
        part = out[(out.source_size == size) & (out.target.sub(want[s]).abs() < 1e-6)]
        assert abs(part.taken.sum() - want[s]) <= 40, s
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    again = mixing.taken(crowded.repartition(7), block=16, shard=50).toPandas()
    order = lambda d: sorted(map(tuple, d.fillna(-1).values.tolist()))
    assert order(out) == order(again)


def test_mixing_reshares_until_none_is_over(spark):
    sizes = {"a": 3, "b": 40, "c": 1000, "d": 0, "e": 7, "f": 5000, None: 2}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    have = {r.source: r.target for r in mixing.targets(df).collect()}
    assert have == pytest.approx(targets(sizes))


def test_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 100):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(0)).alias("to"))
        to = [r.to for r in df.collect()]
        assert sorted(to) == list(range(n)) and (n < 10 or to != sorted(to))


def test_mixed_texts_hold_the_words_taken(docs, rows):
    small = docs.where("doc_id IS NOT NULL AND doc_id < 40")
    taken = {r.doc_id: r.taken for r in mixing.taken(small, block=8, shard=20).collect()}
    out = mixing.mixed_texts(small, block=8, shard=20)
    assert out.columns == docs.columns
    words, texts = Counter(), {i: split(t) for i, t, *_ in rows}
    for r in out.collect():
        words[r.doc_id] += len(split(r.text))
        assert r.n_chars == len(r.text) and set(split(r.text)) <= set(texts[r.doc_id])
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_shards(crowded, rows, empty):
    out = kdtree.shard(crowded, 8).toPandas()
    assert len(out) == len(rows) and kdtree.shard(empty, 8).count() == 0
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted(zip(out["size"], out.text_crc32, strict=True)) == want
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert (out.groupby(["size", "text_crc32"]).shard.nunique() <= 2).all() and out.shard.between(0, 7).all()  # null and empty differ


def test_shards_are_even(spark):
    rng = random.Random(3)
    data = [(i, "x" * rng.randint(0, 400), "en", rng.choice("abc")) for i in range(4000)] + [(5000 + i, "copy " * 40, "en", "a") for i in range(400)]
    out = kdtree.shard(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), 8).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() / size.mean() < 1.05 and size.min() / size.mean() > 0.95
    assert out[out.doc_id >= 5000].shard.nunique() == 1


def test_shards_follow_the_tree(spark):
    """The tree by hand: each node's halves lie apart on its widest dimension, but for one bin, and weigh what is asked."""
    rng = random.Random(6)
    data = [(i, "x" * int(2 ** rng.uniform(0, 11)), rng.choice(["en", "fr", "de", None]), rng.choice("abcdefgh")) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    rows = df.selectExpr("doc_id", "lang", "source", "sha2(concat(binary('1'), binary(text)), 256) AS digest", "octet_length(text) + 1L AS size")
    points = kdtree._dimensions(rows).toPandas().set_index("digest")
    dealt = kdtree.shard(df, 8).select("doc_id", "shard").join(rows.select("doc_id", "digest"), "doc_id").select("digest", F.col("shard").alias("to")).distinct().toPandas().set_index("digest")["to"]
    assert dealt.index.is_unique and points.d0.min() == 0 and points.d0.max() == 1
    points["to"] = dealt
    points = points[points.weight * 8 * kdtree.HEAVY <= points.weight.sum()]
    used = set()
    for depth in range(3):
        for node, part in points.groupby(points.to // (8 >> depth)):
            width = part[kdtree.DIMENSIONS].max() - part[kdtree.DIMENSIONS].min()
            d = width.idxmax()
            used.add(d)
            right = part.to // (8 >> depth + 1) % 2 == 1
            bins = np.minimum(np.floor((part[d] - part[d].min()) / width[d] * kdtree.BINS), kdtree.BINS - 1)
            assert bins[~right].max() <= bins[right].min(), (depth, node, d)
            assert abs(part.weight[right].sum() / part.weight.sum() - 0.5) < 0.02
    assert "d0" in used and len(used) > 1


def vectors():
    rng = np.random.default_rng(5)
    out, i = [], 0
    for label in (0, 1, None):
        centres = rng.normal(size=(12, 16))
        for c in centres:
            for _ in range(rng.integers(1, 9)):
                out.append((i, (c * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2])).astype(np.float32).tolist(), label))
                i += 1
    out += [(900, out[0][1], 0), (901, out[0][1], 1), (902, None, 0), (903, [], 0), (904, [0.0] * 16, 0), (905, [float("nan")] * 16, 0), (906, [None] + [1.0] * 15, 0), (907, [float("inf")] * 16, 0), (908, [1.0] * 8, 0), (909, [-0.0] + [1e-30] * 15, 0), (910, [0.0] + [2e-30] * 15, 0), (None, out[0][1], 0)]
    return out


@pytest.mark.parametrize("small", [64, 1])
def test_close_pairs_in_groups(small, monkeypatch):
    monkeypatch.setattr(cross_polytope, "SMALL", small)
    rng = np.random.default_rng(2)
    x = cross_polytope._unit(np.repeat(rng.normal(size=(20, 8)), 5, axis=0) + rng.normal(size=(100, 8)) * 0.2)
    group = np.sort(rng.integers(0, 9, 100))
    a, b = cross_polytope._close(x, group, 0.9)
    want = {(i, j) for i in range(100) for j in range(i + 1, 100) if group[i] == group[j] and x[i] @ x[j] >= 0.9}
    assert len(want) > 20 and set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_cross_polytope_misses_few():
    rng = np.random.default_rng(3)
    a = cross_polytope._unit(rng.normal(size=(4000, 64)))
    b = rng.normal(size=(4000, 64))
    b = cross_polytope._unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    x, y = cross_polytope.keys(a), cross_polytope.keys(0.98 * a + np.sqrt(1 - 0.98**2) * b)
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.999


@pytest.mark.parametrize(("block", "kind"), [(2000, "float"), (3, "double")])
def test_cross_polytope_equals_brute_force(spark, block, kind, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", block)
    data = vectors()
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'x' AS rep", "'y' AS key", "'z' AS weight")
    out = cross_polytope.near_duplicates(df).toPandas()
    assert len(out) == len(data)
    ok = {i: np.array(v, dtype=np.float64) for i, v, lab in data if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in data}
    links = []
    for a in ok:
        for b in ok:
            if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]):
                x, y = ok[a] / abs(ok[a]).max(), ok[b] / abs(ok[b]).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a, b))
    degree = Counter(x for e in links for x in e)
    want = components([i for i, *_ in data if i is not None], links)
    have = out[out.vec_id.notna()]
    assert len(links) > 60
    assert {int(i): int(n) for i, n in zip(have.vec_id, have.n_links, strict=True)} == {i: degree[i] for i in want}
    assert {int(i): int(c) for i, c in zip(have.vec_id, have.component_id, strict=True)} == want
    assert cross_polytope.near_duplicates(df.limit(0)).count() == 0


def test_sharding_refuses_other_numbers(docs):
    for n in (0, 3, 6, -8):
        with pytest.raises(ValueError, match="power of two"):
            kdtree.shard(docs, n)


def test_vectors_with_an_id_that_repeats(spark):
    """Each row is a vector of its own: rows of one id with equal vectors are linked with each other."""
    v = [0.6, 0.8, 0.0, 0.0]
    df = spark.createDataFrame([(1, v, 0), (1, v, 0), (2, v, 0), (3, [0.0, 0.0, 1.0, 0.0], 0), (3, [0.0, 0.0, 0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cross_polytope.near_duplicates(df).collect())
    assert out == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True)]
