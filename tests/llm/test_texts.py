"""Fertility, byte-level BPE, licences, language models, compression, against plain Python."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
import zstandard
from pyspark.sql import functions as F

from quaestor.llm import bpe, fertility, license_texts, licenses, lm, zstd_quality

PIECES, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab '\n\t  .,é漢🙂s0", max_size=80)))
def test_encoding_equals_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert "".join(codec.decode_stream(ids)) == text


def test_long_matches(codec, library):
    for text in ("a" * 3000, "ab" * 2000, "\n" * 500, "漢" * 400, "the" * 700):
        assert codec.encode(text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine(raw, step):
    m = bpe.Utf8()
    assert "".join(m.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + m.end() == raw.decode("utf-8", "replace")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 255) | st.integers(256, 50255), max_size=30))
def test_streams_of_any_ids(codec, ids):
    raw = b"".join(codec.transducer.bytes_of[i] for i in ids)
    assert codec.decode(ids) == "".join(codec.decode_stream(ids)) == raw.decode("utf-8", "replace")


def test_decoding_runs_the_utf8_machine(codec, monkeypatch):
    fed = []
    feed = bpe.Utf8.feed
    monkeypatch.setattr(bpe.Utf8, "feed", lambda self, raw: fed.append(raw) or feed(self, raw))
    streams = bpe.Streams(codec.transducer.bytes_of)
    ids = codec.encode("plain 漢字 🙂")
    assert {codec.transducer.bytes_of[i] for i in ids} <= set(fed) and streams.text(ids) == "plain 漢字 🙂"


def test_few_states_kept(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 3)
    monkeypatch.setattr(bpe, "MAX_MATCHES", 3)
    small = bpe.Codec(RANKS, P.PATTERN)
    text = "Several words, of different kinds; and more words.  End"
    assert [small.encode(text) for _ in range(3)] == [library.encode_ordinary(text)] * 3


def test_round_trip(spark, crowded, rows, empty, library):
    out = sorted(tuple(r)[:4] for r in bpe.round_trip(crowded, RANKS, P.PATTERN).collect() if r.doc_id is not None)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert out == sorted(w for w in want if w[0] is not None)
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def base(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen = Counter(lines)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(v - 1 for v in seen.values()), len(hit)


def test_fertility_base_equals_brute_force(crowded, rows, empty):
    out = fertility.judge(crowded, PIECES, RANKS, P.PATTERN).toPandas()
    assert len(out) == len(rows)
    have = sorted(tuple(map(int, r)) for r in out[out.doc_id.notna()][["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False))
    assert have == sorted((i, *base(t)) for i, t, *_ in rows if i is not None)
    failed = (out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words)
    assert (out.base_failed == failed).all() and not (out.kept & failed).any()
    assert fertility.judge(empty, PIECES, RANKS, P.PATTERN).count() == 0


def verdicts(rows):
    """Measures, bands and verdicts of op1 from the two libraries and the module's constants, with exact medians."""
    import base64

    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t, lang, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        plain, n = " ".join(words), len(words)
        ids = pieces.encode(plain) if words else []
        share = [c / len(ids) for c in Counter(ids).values()]
        m = {"i": i, "n": n, "script": fertility.script(t or ""), "lang": lang, "chars": sum(map(len, words)) / max(1, len(coder.encode_ordinary(plain))) if words else None, "bytes": sum(map(pieces.is_byte, ids)) / len(ids) if ids else 0.0, "entropy": -sum(x * math.log2(x) for x in share), "pieces": len(ids)}
        out.append(m | {"shaky": math.sqrt(max(1.0, fertility.STEADY / max(n, 1)))})
    middle = lambda values: sorted(values)[(len(values) - 1) // 2]
    for m in out:
        if m["chars"] is None:
            m["failed"] = True
            continue
        low, high, most_bytes = fertility.BANDS[m["script"]]
        median, deviation = (low + high) / 2, (high - low) / (2 * fertility.DEVIATIONS)
        for key in ("script", "lang"):
            own = [x for x in out if x["chars"] is not None and x[key] == m[key]]
            mid = middle([x["chars"] for x in own])
            far = middle([abs(x["chars"] - mid) / x["shaky"] for x in own])
            median, deviation = ((len(own) * a + fertility.PRIOR_TEXTS * b) / (len(own) + fertility.PRIOR_TEXTS) for a, b in ((mid, median), (far, deviation)))
        width = max(fertility.DEVIATIONS * deviation, fertility.LEAST_SHARE * median) * m["shaky"]
        least = fertility.LEAST_ENTROPY * min(1.0, math.log2(max(m["pieces"], 1)) / math.log2(fertility.STEADY))
        m["failed"] = m["chars"] < low or m["chars"] > high or m["bytes"] > most_bytes or m["entropy"] < least or abs(m["chars"] - median) > width
    return out


def test_fertility_verdicts_equal_brute_force(crowded, rows):
    out = {r.doc_id: r for r in fertility.judge(crowded, PIECES, RANKS, P.PATTERN).collect() if r.doc_id is not None}
    want = {m["i"]: m for m in verdicts(rows) if m["i"] is not None}
    for i, m in want.items():
        r = out[i]
        if m["chars"] is None:
            assert (r.chars_per_token, r.byte_share, r.token_entropy) == (None, None, None)
        else:
            assert math.isclose(r.chars_per_token, m["chars"]) and math.isclose(r.byte_share, m["bytes"], abs_tol=1e-12) and math.isclose(r.token_entropy, m["entropy"], abs_tol=1e-9)
        assert (r.fertility_failed, r.kept) == (m["failed"], not m["failed"] and not r.base_failed), i
    assert {m["failed"] for m in want.values()} == {True, False}


def test_fertility_bands(spark):
    rng = np.random.default_rng(1)
    names = "table house river window people school water garden evening market stone paper letter doctor winter island bridge summer kitchen forest".split()
    good = [" ".join(rng.choice(names, 300)) + f" {i} " + " ".join(rng.permutation([f"{a} {b} and" for a in names for b in names])) for i in range(60)]
    noise = " ".join("".join(rng.choice(list("qxzjkvw#%"), 9)) for _ in range(400))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, noise])], "doc_id long, text string, lang string")
    out = fertility.judge(df, PIECES, RANKS, P.PATTERN).toPandas().set_index("doc_id").sort_index()
    assert not out.fertility_failed[:60].any() and out.fertility_failed[60]


@pytest.mark.parametrize("n_texts", [60, 20])
def test_fertility_bands_of_short_texts(spark, n_texts):
    rng = np.random.default_rng(2)
    names = "table house river window people school water garden evening market stone paper letter doctor winter island bridge summer kitchen forest".split()
    good = [" ".join(rng.permutation([f"{a} {b} and" for a in names for b in names])[:30]) for _ in range(n_texts)]
    noise = " ".join("".join(rng.choice(list("aeioubcdfg"), 9)) for _ in range(90))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, noise, "ha " * 60])], "doc_id long, text string, lang string")
    out = fertility.judge(df, PIECES, RANKS, P.PATTERN).toPandas().set_index("doc_id").sort_index()
    low, high, _ = fertility.BANDS["latin"]
    assert (out.n_words < fertility.STEADY).all() and low < out.chars_per_token[n_texts] < high
    assert not out.fertility_failed[:n_texts].any() and out.fertility_failed[n_texts] and out.fertility_failed[n_texts + 1]
    assert set(out.columns) >= {"chars_per_token", "kept"} and "n_pieces" not in out


def test_scripts():
    assert [fertility.script(t) for t in ("abc Ж", "Привет, мир", "漢字かな x", "12 — ", "")] == ["latin", "cyrillic", "cjk", "other", "other"]


def test_licenses(spark, crowded, empty):
    known = licenses.known(spark)
    mit = licenses.KNOWN["MIT"]
    same = mit.upper().replace(",", " ;").replace("MIT LICENSE\n", "MIT Licence\nCopyright (c) 2020 Somebody\n(c) others\nAll rights reserved.\n")
    df = spark.createDataFrame([(1, mit), (2, same), (3, mit[:-20]), (4, None), (5, ""), (6, "Copyright 2020"), (7, mit + " and more")], "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan(df, known).collect()}
    assert [out[i].license_id for i in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None]
    assert out[4].digest == out[5].digest == out[6].digest == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(crowded, known).count() == crowded.count() and licenses.scan(empty, known).count() == 0


def test_licenses_in_published_layouts(spark):
    wrap = lambda t, n: "\n\n".join(p if "(c)" in p.lower() else textwrap.fill(p, n) for p in re.split(r"\n\s*\n", t))
    whole = {k: v for k, v in licenses.KNOWN.items() if not k.endswith("notice") and not k.startswith("MIT")} | {"MIT": licenses.KNOWN["MIT-text"]}
    whole = {k: t for k, t in whole.items() if k not in ("Unlicense", "BSL-1.0")}
    titles = {"ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "0BSD": "BSD Zero Clause License", "Zlib": "zlib License", "MIT": "The MIT License (MIT)"}
    lines = ("Copyright (c) 2019, A Holder <a@b.c>", "Copyright The Holders of it", "© 2020 Somebody\nAll rights reserved.", "Copyright: 2001-2004 Some Others")
    data = [(k, f"{titles[k]}\n\n{line}\n\n{wrap(t, n)}") for k, t in whole.items() for n, line in zip((60, 72, 78, 20), lines, strict=True)]
    data += [("ISC", "Copyright (c) 2004-2010 by Somebody\n\n" + licenses.KNOWN["ISC"].replace("above copyright", "above\ncopyright"))]
    data += [("Apache-2.0", t := dict(license_texts.more())["Apache-2.0"]), ("Apache-2.0", t.replace("[yyyy] [name of copyright owner]", "2020 Somebody"))]
    data += [(k, wrap(t, n)) for k, t in license_texts.more() if k in ("GPL-2.0", "GPL-3.0", "MPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0", "GPL-1.0") for n in (70, 100)]
    data += [("MPL-1.1", dict(license_texts.more())["MPL-1.1"]), ("Unlicense", wrap(licenses.KNOWN["Unlicense"], 72)), ("Unlicense", licenses.KNOWN["Unlicense"].replace("https://unlicense.org", "http://unlicense.org/")), ("BSL-1.0", licenses.KNOWN["BSL-1.0"].replace("organization", "organisation"))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "doc_id long, text string")
    out = {r.doc_id: r.license_id for r in licenses.scan(df, licenses.known(spark)).collect()}
    assert [(i, k) for i, (k, _) in enumerate(data)] == sorted((i, {"MIT-text": "MIT"}.get(k, k)) for i, k in out.items())
    odd = ["licence licence LICENCE", "Copyright  notice and this\nkept", "copyright notices\nx", "copyright\nx", "copyright and\r\n(c) One Two Three\r\nx", "(c) one two three four five\nx", "(c)\u00a0x\u2028\nx", "ALL RIGHTS RESERVED.\u0085\nx", "copyrighté 2020\nx", "copyright andé\nx", "\n\n©\n\n", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*(t for _, t in data), *odd])], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {i: (d, k) for i, d, k in con.sql(licenses.oracle()).fetchall()}
    have = {r.doc_id: (r.digest, r.license_id) for r in licenses.scan(df, licenses.known(spark)).collect()}
    assert have == want and have[len(data)][0] == hashlib.sha256(b"license license license").hexdigest()
    assert [have[len(data) + i][0] for i in (1, 2)] == [hashlib.sha256(t).hexdigest() for t in (b"copyright notice and this kept", b"copyright notices x")]


@pytest.mark.parametrize(("chunk_words", "part_keys"), [(lm.CHUNK_WORDS, lm.PART_KEYS), (50, lm.PART_KEYS), (50, 100)])
def test_language_models_equal_brute_force(spark, docs, crowded, rows, empty, monkeypatch, chunk_words, part_keys):
    monkeypatch.setattr(lm, "CHUNK_WORDS", chunk_words)
    monkeypatch.setattr(lm, "PART_KEYS", part_keys)
    monkeypatch.setattr(lm, "BLOCK_CHARS", 100 * chunk_words)
    target = spark.createDataFrame([(i,) for i in (1, 2, 3, 45, 45, None)], "doc_id long")
    found = lm.score(crowded, target).collect()
    out = {r.doc_id: r for r in found if r.doc_id is not None}
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    split = lambda t: [w.lower() for w in (t or "").encode().split()]
    for i, t, *_ in rows:
        own = split(t)
        for k in range(2 if i in (1, 2, 3, 45) else 1):
            one[k].update(own)
            two[k].update(zip(own, own[1:], strict=False))
    n, different = one[1].total(), len(one[0])
    for i, t, *_ in rows:
        own = split(t)
        if i is None or not own:
            continue
        for name, k in (("background_bits", 0), ("target_bits", 1)):
            scale = n / one[k].total()
            p1 = lambda w: (one[k][w] * scale + 1) / (n + different)  # noqa: B023, E731
            bits = [-math.log2(p1(own[0]))]
            for v, w in zip(own, own[1:], strict=False):
                bits.append(-math.log2((two[k][v, w] * scale + lm.PRIOR * p1(w)) / (one[k][v] * scale + lm.PRIOR)))
            assert math.isclose(getattr(out[i], name), sum(bits) / len(bits), rel_tol=1e-9)
    assert out[54].n_tokens == out[55].n_tokens == 0 and out[54].difference is None and out[1].difference < out[0].difference
    assert lm.score(empty, target).count() == 0
    assert {r.difference for r in lm.score(docs, target.limit(0)).collect()} == {0.0, None}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    good = ["the", "river", "runs", "through", "valley", "and", "people", "walk", "along", "it", "slowly"]
    bad = ["BUY!!", "$$$", "###", "CLICK***", "NOW!!", "%%%", "WIN&&&"]
    data = [(i, " ".join(rng.choice(good if i % 2 else bad, 80)), i % 2) for i in range(400)]
    return spark.createDataFrame(data, "doc_id long, text string, quality int")


def test_compression_classifier(spark, labelled, crowded, empty):
    labels = labelled.select("doc_id", "quality").unionAll(spark.createDataFrame([(None, 1), (1, None), (3, 7)], "doc_id long, quality int"))
    model = zstd_quality.train(labelled.select("doc_id", "text"), labels)
    out = zstd_quality.score(labelled, model).withColumn("held", zstd_quality.held_out(F.col("doc_id"))).toPandas()
    assert [bool(h) for h in out.held] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]
    assert (out[out.held].predicted == out[out.held].quality).mean() > 0.98
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    odd = zstd_quality.score(crowded, model).toPandas()
    assert odd.score.notna().all() and len(odd) == crowded.count() and zstd_quality.score(empty, model).count() == 0


def test_compression_equals_plain_zstandard(spark, labelled):
    """Sizes by compressing each whole text's pieces again; rows of two labels and texts over the bound are not learnt."""
    model = zstd_quality.train(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"))
    sizes = lambda d, t: sum(len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t[i : i + 1024])) for i in range(0, len(t), 1024))
    for r in zstd_quality.score(labelled.limit(20).withColumn("text", F.repeat("text", 5)), model).collect():
        good, bad = (sizes(d, r.text.encode()) for d in (model.good, model.bad))
        assert math.isclose(r.size_difference, (bad - good) / (bad + good)) and math.isclose(r.score, 1 / (1 + math.exp(-(model.slope * r.size_difference + model.shift))))
    twice = labelled.select("doc_id", "quality").unionAll(labelled.select("doc_id", (1 - F.col("quality")).alias("quality")))
    nothing = zstd_quality.train(labelled.select("doc_id", "text"), twice)
    assert (nothing.good, nothing.bad, nothing.slope) == (b" " * 8, b" " * 8, 0.0)
    some = zstd_quality.train(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"), most_bytes=2000)
    texts = [r.text.encode() for r in labelled.collect()]
    long = zstd_quality.train(labelled.select("doc_id", F.repeat("text", 50).alias("text")), labelled.select("doc_id", "quality"), most_bytes=2000)
    assert 0 < len(some.good) <= 2000 and any(some.good.endswith(t[-64:]) for t in texts) and long.good == b" " * 8


def test_compression_without_labels(spark, docs):
    model = zstd_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert zstd_quality.score(docs, model).where("score = 0.5 AND predicted = 1").count() == docs.count()


def test_labels_held_out_are_not_learnt(spark, labelled):
    flipped = labelled.withColumn("quality", F.when(zstd_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (zstd_quality.train(labelled.select("doc_id", "text"), x.select("doc_id", "quality")) for x in (labelled, flipped))
    assert (a.good, a.bad, a.slope, a.shift) == (b.good, b.bad, b.slope, b.shift)


