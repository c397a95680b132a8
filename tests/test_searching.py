"""Search over the whole corpus, and its measures, against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest

from quaestor.plans import searching
from quaestor.plans.catalogue import QUERIES

ITEMS = ("1A", "7", "7A", "8")


def words(text):
    return re.findall(r"[a-z0-9$%.]+", text.lower())


def squeezed(text):
    return " ".join(text.split()).lower()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Forty documents in which a question's text stands in documents of any number, whole, with other white space, or only begun."""
    import random

    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(n))
    asked = [(i, say(12)) for i in range(8)]
    docs = []
    for i in range(40):
        _, q = asked[i % 8]
        body = {0: f"{say(20)} {q} {say(30)}", 1: f"{say(10)} {q.upper().replace(' ', '  ', 3)} {say(30)}", 2: f"{q[:14]} {say(90)}"}.get(i // 8, say(90))
        docs.append((i, body, "en", "s", len(body)))
    talks = [(i, 0, "user", asked[(i + 1) % 8][1]) for i in (0, 1, 2)]
    vectors = [(i, [math.cos(i), math.sin(i)], i % 4) for i in range(40)]
    d = tmp_path_factory.mktemp("small")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d), docs, dict(asked), dict((c[0], c[3]) for c in talks)


def bm25(corpus, asked):
    """{query: [(score, id)] in order}, of a corpus {id: text}."""
    tf = {i: Counter(words(t)) for i, t in corpus.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, average = len(tf), sum(c.total() for c in tf.values()) / len(tf)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = round(0.25 * sum(raw.values()) / len(raw), 9)
    out = {}
    for q, text in asked.items():
        found = []
        for i, c in tf.items():
            common = [w for w in words(text) if w in c]
            s = sum((raw[w] if raw[w] >= 0 else floor) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / average)) for w in common)
            if common:
                found.append((-round(s, 6), i))
        out[q] = [(-s, i) for s, i in sorted(found)]
    return out


@pytest.fixture(scope="module")
def ranking(small):
    _, docs, asked, _ = small
    chunks = {}
    for i, text, *_ in docs:
        for p in range(max(len(text) - 1 - 80, 0) // 320 + 1):
            chunks[f"S.{i}-{2024 + i % 2}-{ITEMS[i % 4]}-{p:04d}"] = (i, p, text[p * 320 : p * 320 + 400])
    return chunks, bm25({k: c[2] for k, c in chunks.items()}, asked)


def test_hits_are_the_best_of_all_chunks(spark, small, ranking):
    chunks, best = ranking
    got = defaultdict(list)
    for r in searching.hits(spark, small[0]).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(r.score, 5), r.chunk_id))
    assert got == {q: [(round(s, 5), i) for s, i in b[:20]] for q, b in best.items()}
    # documents of other numbers than the question's are among them
    assert any(chunks[i][0] % 40 != q % 40 for q, b in best.items() for _, i in b[:1])


def test_views_of_the_hits(spark, small, ranking):
    chunks, best = ranking
    rows = {n: QUERIES[n](spark, small[0]).collect() for n in ("parent_expand", "best_parent", "parse_hit_ids", "hit_projection", "search_contract")}
    for q, b in best.items():
        parents = {}
        for rank, (_, i) in enumerate(b[:20], 1):
            parents.setdefault(re.sub("-[^-]*$", "-0000", i), []).append((rank, i))
        assert {(r.parent, r["rank"], r.n) for r in rows["best_parent"] if r.query_id == q} == {(p, v[0][0], len(v)) for p, v in parents.items()}
        assert [r.chunk_id for r in sorted(rows["parent_expand"], key=lambda r: r.parent_rank) if r.query_id == q] == [v[0][1] for v in list(parents.values())[:3]]
        assert [r.ids for r in rows["parse_hit_ids"] if r.query_id == q] == [",".join(i for _, i in b[:3])]
        assert {(r.chunk_id, r.posicion) for r in rows["hit_projection"] if r.query_id == q} == {(i, chunks[i][1]) for _, i in b[:5]}
    assert all(r.within_k and r.unique_ids and r.filter_respected for r in rows["search_contract"]) and len(rows["search_contract"]) == 8
    one_year = {q: [i for _, i in b if "-2024-" in i][:20] for q, b in best.items()}
    assert {(r.query_id, r.chunk_id) for r in searching.hits(spark, small[0], fiscal_year=2024).collect()} == {(q, i) for q, b in one_year.items() for i in b}


def test_whole_anchors(spark, small, ranking):
    d, docs, asked, _ = small
    chunks, best = ranking
    bodies = {i: t for i, t, *_ in docs}
    holding = {(q, i) for q, a in asked.items() for i, t in bodies.items() if squeezed(a) in squeezed(t)}
    assert {(r.query_id, r.doc_id, r.start) for r in searching.owners(spark, d).collect()} == {(q, i, bodies[i].find(asked[q]) if asked[q] in bodies[i] else None) for q, i in holding}
    assert any(asked[q] not in bodies[i] for q, i in holding)
    got = {n: {r.query_id: r[1] for r in QUERIES[n](spark, d).collect()} for n in ("anchor_recall_trace", "anchor_recall_isolated", "anchor_rank")}
    pivot = {r.query_id: (r.exact, r.loose) for r in QUERIES["anchor_rank_pivot"](spark, d).collect()}
    for q, b in best.items():
        exact = [rank for rank, (_, i) in enumerate(b[:20], 1) if asked[q] in chunks[i][2]]
        loose = [rank for rank, (_, i) in enumerate(b[:20], 1) if squeezed(asked[q]) in squeezed(chunks[i][2])]
        assert got["anchor_recall_trace"][q] == any(r <= 5 for r in exact)
        assert got["anchor_recall_isolated"][q] == any(r <= 5 for r in loose)
        assert got["anchor_rank"][q] == min(loose, default=None) and pivot[q] == (min(exact, default=None), min(loose, default=None))
        # a text that has no more than the anchor's beginning is no hit
        begun = [rank for rank, (_, i) in enumerate(b, 1) if chunks[i][2].startswith(asked[q][:12]) and squeezed(asked[q]) not in squeezed(chunks[i][2])]
        assert begun and not set(begun) & set(loose)
    assert QUERIES["recall_at_k"](spark, d).first().recall == round(sum(got["anchor_rank"][q] is not None and got["anchor_rank"][q] <= 5 for q in asked) / len(asked), 6)


def test_six_retrievers_are_compared(spark, small):
    d, docs, asked, talks = small
    bodies = {i: t for i, t, *_ in docs}
    near = {q: sorted((-round(math.cos(q) * math.cos(i) + math.sin(q) * math.sin(i), 5), i) for i in bodies) for q in asked}
    said = {q: talks.get(q, t) for q, t in asked.items()}
    order = {"flat": {q: [i for _, i in near[q]] for q in asked}, "filtered": {q: [i for _, i in near[q] if i % 4 == q % 4] for q in asked}}
    for lexical, fused, text in (("bm25", "fused", asked), ("rewrite", "rewrite_fused", said)):
        best = bm25(bodies, text)
        order[lexical] = {q: [i for _, i in best[q]] for q in asked}
        order[fused] = {}
        for q in asked:
            at = {i: r for r, i in enumerate(order[lexical][q], 1)}
            order[fused][q] = [i for *_, i in sorted((-round(1 / (60 + r) + 1 / (60 + at.get(i, 1_000_000)), 9), r, i) for r, i in enumerate(order["flat"][q], 1))]
    got = defaultdict(dict)
    for r in searching.configurations(spark, d).collect():
        got[r.config].setdefault(r.query_id, {})[r["rank"]] = r.id
    assert {c: {q: [x[r] for r in sorted(x)] for q, x in v.items()} for c, v in got.items()} == {c: {q: x[:20] for q, x in v.items()} for c, v in order.items()}
    study = {(r.config, r.k, r.strict): r for r in QUERIES["recall_study"](spark, d).collect()}
    assert len(study) == 36
    share = {}
    for (c, k, strict), r in study.items():
        hit = {q for q, a in asked.items() if any((a in bodies[i]) if strict else squeezed(a) in squeezed(bodies[i]) for i in order[c][q][:k])}
        assert (r.n, r.hits, r.missed) == (8, len(hit), ", ".join(str(q) for q in sorted(set(asked) - hit)))
        share[c, k, strict] = len(hit) / 8
    best = QUERIES["recall_pooled_best"](spark, d).collect()
    assert [(b.config, b.k, b.strict) for b in best] == [min(share, key=lambda x: (-share[x], x[1], x[2], x[0]))]


def test_data_sets_are_pooled(spark, small):
    d, docs, asked, _ = small
    bodies = {i: t for i, t, *_ in docs}
    rows = {(r.dataset, r.config, r.k, r.strict): r for r in QUERIES["study_by_dataset"](spark, d).collect()}
    study = {(r.config, r.k, r.strict): r.hits for r in QUERIES["recall_study"](spark, d).collect()}
    assert {x[1:]: r.hits for x, r in rows.items() if x[0] == "whole"} == study and len(rows) == 72
    short = bm25(bodies, {q: " ".join(t.split()[: searching.SHORT]) for q, t in asked.items()})
    for k in (1, 5, 20):
        assert rows["short", "bm25", k, False].hits == sum(any(squeezed(a) in squeezed(bodies[i]) for _, i in short[q][:k]) for q, a in asked.items())
    pooled = {(r.config, r.k, r.strict): (r.hits, r.n, r.best) for r in QUERIES["study_pooled"](spark, d).collect()}
    assert {x: v[:2] for x, v in pooled.items()} == {x: (study[x] + rows["short", *x].hits, 16) for x in study}
    assert [x for x, v in pooled.items() if v[2]] == [min(pooled, key=lambda x: (-round(pooled[x][0] / 16, 6), x[1], x[2], x[0]))]
