"""Source divergence, hard negatives and URL rules, against brute force and their SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quaestor.llm import divergence, hard_negatives, queries, url_rules


def table(frame):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


def same_as_sql(out, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    want = con.sql(sql).df()
    return table(out[sorted(out.columns)]) == table(want[sorted(want.columns)])


# Source divergence.


def divergence_by_hand(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [(lang or "", source or "", term.findall((text or "").translate(lower))) for text, lang, source in rows]
    found = defaultdict(Counter)
    for lang, _, terms in docs:
        found[lang].update(set(terms))
    out = []
    for lang in {d[0] for d in docs}:
        kept = {t for t, n in found[lang].items() if n >= least}
        every = {"whole": Counter(t for d in docs if d[0] == lang for t in d[2] if t in kept)}
        groups = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in {d[1] for d in docs if d[0] == lang}}
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(-sum(f(p(c, t), p(o, t)) for t in kept), other.encode(), other) for other, o in groups.items() if other != s]
            terms = [(-f(p(c, t), p(every["whole"], t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(every["whole"], t)]
            out += [(lang, s, "pair", item, -value, i) for i, (value, _, item) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", item, -value, i) for i, (value, _, item) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 2, 4, 1000])
def test_divergence_equals_brute_force(crowded, rows, least):
    out = divergence.audit(crowded, least, 10).select("lang", "source", "part", "item", "value", "rank").toPandas()
    assert table(out) == divergence_by_hand([r[1:4] for r in rows], least, 10)


def test_divergence_equals_sql_and_counts_zero_cells(spark, crowded, empty):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("alpha beta Gamma delta épée 漢字 zeta eta one two".split()) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None, "zz"])) for i in range(300)]
    docs += [(300 + i, "only here " * 3, "en", "b") for i in range(12)] + [(None, None, "de", "a"), (1, "12 34 --", "de", "b"), (2, "x", "xx", "alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    out = divergence.audit(df).toPandas()
    assert same_as_sql(out, divergence.oracle(), documents=df.toPandas())
    assert table(out[["lang", "source", "part", "item", "value", "rank"]]) == divergence_by_hand([d[1:] for d in docs], 10, 10)
    assert set(out[out.lang == "de"].value) == {0} and not len(out[out.lang == "xx"])  # no kept terms; no other source
    assert divergence.audit(empty).count() == 0


def test_divergence_counts_beyond_a_product_of_longs(spark):
    big = 10**12
    row = spark.range(1).selectExpr(f"{big}L AS c", f"{7 * big}L AS n", "5L AS v").select(divergence.probability("c", "n", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (7 * big + 10)


# Hard negatives.

KINDS = "vec_id long, embedding array<{}>, label int, id string, score string, vector string, rank string"


def vectors_at_random(rng, n, d=16):
    out = []
    for i in range(n):
        v = rng.normal(size=d).astype(np.float32)
        out.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    for i in range(n, n + 40):  # copies, which tie
        out.append((i, out[i % 7][1], int(rng.integers(0, 4))))
    return out


ODD = [(900, None, 1), (1000, [0.0] * 16, 1), (1100, [None] + [1.0] * 15, 1), (1200, [float("nan")] * 16, 2), (1300, [float("inf")] * 16, 2), (1400, [0.5] * 16, None), (1500, [], 3), (1600, [0.25] * 3, 0), (1601, [0.5] * 3, 0), (1602, [0.4] * 3, 1)]


def negatives_by_hand(rows, positives=5, negatives=5, percent=80):
    good = {i: (label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, (label, v) in good.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for i, (own, w) in good.items() if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, i, n, x[1], -s, -x[0]) for n, x in enumerate(hard, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("shape", [(16_384, 512, 64), (40, 7, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind, shape):
    for name, value in zip(("BLOCK", "LEAST", "BLOCKS"), shape, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors_at_random(np.random.default_rng(3), 620) + ODD + [(None, [0.1] * 16, 1)]
    rows += [rows[3], rows[300]]  # a row that repeats counts once
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], KINDS.format(kind))
    out = hard_negatives.mine(df, "id % 100 = 0").toPandas()
    want = negatives_by_hand(rows)
    assert len(want) > 100 and table(out) == want


def test_hard_negatives_of_great_numbers_and_of_no_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(1e12, 1e12 + 1e6) for _ in range(4)], i % 3) for i in range(0, 400, 4)]
    kinds = "vec_id long, embedding array<double>, label int"
    out = hard_negatives.mine(spark.createDataFrame(rows[:0], kinds), "id % 100 = 0")
    assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    a = np.array([[2.0**40, 1.0], [2.0**30, 3.0]])
    assert hard_negatives.products(a, a).tolist() == [[hard_negatives.MOST] * 2, [hard_negatives.MOST, 2**60 + 9]]
    found = hard_negatives.mine(spark.createDataFrame([(i, [x / 1e6 for x in v], c) for i, v, c in rows], kinds), "id % 100 = 0").toPandas()
    assert table(found) == negatives_by_hand([(i, [x / 1e6 for x in v], c) for i, v, c in rows])


def test_hard_negatives_equal_sql(spark, tmp_path):
    rows = vectors_at_random(np.random.default_rng(8), 500) + ODD
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op12_hard_negatives(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(hard_negatives.oracle()).df()
    assert len(want) > 50 and table(out[sorted(out.columns)]) == table(want[sorted(want.columns)])


# URL rules.

URLS = [
    "http://example.com/en/1", "https://www.example.com/en/1", "https://a.WWW.Example.com/en/x?y#z", "https://example.com/fr/1", "http://example.com", "http://example.com?x/en/", "http://example.com#/en/", "http://net/es/", "HTTP://a.net/es",
    "http://a.net/fr/y", "http://anet/fr/y", "http://xexample.com/en/1", "http://evil.org/x.com/en/", "http://evil.org?.com/en/", "no scheme.com/en/", "://com/", "x://y://com/en/", "", None, "http://", "http:///en/", "http://com/", "http://com:80/en/",
    "http://user@example.com/en/", "http://example.com./en/", "http://a.org/LOGIN", "http://a.org/login/x", "http://a.org/logins", "http://a.org/login?next=1", "http://a.org/f.EXE", "http://a.org/f.exe?x", "http://a.org/x?a=1&SessionID=9", "http://a.casino/",
    "http://best-casino.org/", "http://best-casino.org", "http://ünï.org/ß/漢字.jpg", "http://a.org/line\nbreak.png", "http://a.org/" + "x" * 70_000 + ".zip", "http://a.org/\x00/wp-admin/", "http://b.net/es/x.jpg", "http://shop.com/cart/", "http://shop.org/cart/",
]


def fits_by_hand(glob, text):
    """By dynamic programming over the pieces of a glob."""
    states = {0}
    pieces = url_rules.tokens(glob)

    def closed(states):
        out = set(states)
        for i in range(len(pieces)):
            if i in out and pieces[i] in ("*", "**"):
                out.add(i + 1)
        return out

    states = closed(states)
    for c in text:
        now = set()
        for i in states:
            if i == len(pieces):
                continue
            p = pieces[i]
            if p == "**" or p == "*" and c not in "/?":
                now.add(i)
            elif p == "?" or len(p) == 2 and p[0] == "\\" and (c == p[1] or c.isascii() and c.lower() == p[1].lower()):
                now.add(i + 1)
        states = closed(now)
    return len(pieces) in states


def judge_by_hand(url, rules=url_rules.RULES, globs=url_rules.GLOBS):
    host = path = query = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("#", 1)[0]
        host = re.match(r"[^/?]*", rest)[0]
        path, _, tail = rest[len(host) :].partition("?")
        query = "?" + tail if "?" in rest else ""
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    hit = next((g for g in globs if fits_by_hand(g, "." + host + path + query)), None)
    return host, path, best and best[1] + best[2], best[0] if best else "block" if hit else "allow", hit


def test_url_rules_equal_brute_force_and_sql(spark):
    df = spark.createDataFrame([(i, u, "x", "x", "x") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], "x", "x", "x")], "page_id long, url string, host string, path string, rule string")
    out = url_rules.judge(df).toPandas()
    have = {int(r.page_id): (r.host, r.path, r.rule, r.verdict, r.wildcard) for r in out.itertuples() if not math.isnan(r.page_id)}
    assert len(out) == len(URLS) + 4
    for i, u in enumerate(URLS):
        if u is None or len(u) < 1000:
            assert have[i] == judge_by_hand(u), u
    assert {v[2] for v in have.values()} == {None, *map(url_rules.rule_name, url_rules.RULES)}
    assert same_as_sql(out, url_rules.oracle(), pages=df.toPandas())
    assert url_rules.judge(df.limit(0)).count() == 0


def test_many_globs_at_once(spark):
    """Thousands of bits, stars in all places, characters of several bytes, random texts."""
    rng = random.Random(6)
    globs = ["".join(rng.choice(["a", "b", "*", "**", "?", "/", "é", "\\?"]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    texts = ["".join(rng.choice("aAbé/?漢") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    import pyarrow as pa

    machine = url_rules.Automaton([(g, True) for g in globs])
    assert machine.words > 10
    column = pa.array(["skip", *texts]).slice(1)
    matched = machine.match(column)
    assert matched.tolist() == [[fits_by_hand(g, t) for g in globs] for t in texts] and matched.any(axis=0).sum() > 100
    small, url_rules.STATE_BITS = url_rules.STATE_BITS, 1
    assert (machine.match(column) == matched).all()
    url_rules.STATE_BITS = small
    other = url_rules.judge(spark.createDataFrame([("p", "http://h.org/q")], "page string, link string"), (), ("*.org/?",), "page", "link").first()
    assert (other.page_id, other.verdict, other.rule) == ("p", "block", None)
    assert url_rules.judge(spark.createDataFrame([(1, "http://h.org/q")], "page_id int, url string"), (), ()).first().verdict == "allow"
