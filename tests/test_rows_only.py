"""Queries that SQL can't express, on the smallest tables, against plain Python."""

import difflib
import hashlib
import os
import re
import unicodedata

import duckdb
import pytest

from quaestor.functions import udfs
from quaestor.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return lambda name, columns: duckdb.sql(f"SELECT {columns} FROM '{DIR}/{name}.parquet'").fetchall()


def form(t):
    return re.sub(r"\s+", " ", t).strip().lower().replace("ß", "ss")


def test_message_similarity(spark, table):
    said = {}
    for c, n, t in sorted(table("conversations", "conv_id, turn, text")):
        said.setdefault(c, []).append((n, t))
    want = {(c, a[0]): round(difflib.SequenceMatcher(None, form(a[1]), form(b[1])).ratio(), 9) for c, x in said.items() for a, b in zip(x, x[1:], strict=False)}
    assert {(r.conv_id, r.turn): r.similarity for r in QUERIES["line_similarity"](spark, DIR).collect()} == want


def test_folded_texts(spark, table):
    fold = lambda t: " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold().split())
    assert {r.doc_id: r.digest for r in QUERIES["accent_fold_full"](spark, DIR).collect()} == {i: hashlib.md5(fold(t).encode()).hexdigest() for i, t in table("documents", "doc_id, text")}


def test_file_digests(spark):
    want = set()
    for name in os.listdir(DIR):
        with open(f"{DIR}/{name}", "rb") as f:
            raw = f.read()
        want.add((name, len(raw), hashlib.sha256(raw).hexdigest()))
    assert {tuple(r) for r in QUERIES["file_hashes"](spark, DIR).collect()} == want


def literal(quote, text):
    """By a regular expression over the text: the quote's characters in order, any space between them, other marks and cases alike."""
    marks = {**dict.fromkeys("\"“”„«»", "[\"“”„«»]"), **dict.fromkeys("'‘’‚‹›", "['‘’‚‹›]"), **dict.fromkeys("-–—−", "[-–—−]")}
    parts = [[c for c in p if not c.isspace()] for p in quote.split("…")]
    if sum(map(len, parts)) < 20 or any(len(p) < 4 for p in parts):
        return None
    found = re.search(r"(?:.|\n)*?".join(r"\s*".join(marks.get(c, re.escape(c)) for c in p) for p in parts), text, re.IGNORECASE)
    return found and found[0]


def test_spans_of_edited_quotes(spark, table):
    have = {r.doc_id: r.found for r in QUERIES["quote_span"](spark, DIR).collect()}
    texts = dict(table("documents", "doc_id, text"))
    assert have.keys() == texts.keys() and sum(f is not None for f in have.values()) > 100
    for i, t in texts.items():
        quote = t[10:50].upper() + " … " + t[70:110].replace(" ", "  ")
        if t.isascii():
            assert have[i] == literal(quote, t), i


def test_quotes_found_in_the_first_chunk_that_has_them(spark, table):
    have = {r.doc_id: (r.chunk_id, r.found) for r in QUERIES["quote_repair"](spark, DIR).collect()}
    for i, source, t in table("documents", "doc_id, upper(source), text"):
        if len(t) <= 120:
            assert i not in have
            continue
        quote = t[30:90].replace(" ", "   ")
        item = ("1A", "7", "7A", "8")[i % 4]
        chunks = [t[p * 320 : p * 320 + 400] for p in range(max(len(t) - 81, 0) // 320 + 1)]
        want = next(((f"{source}.{i}-{2024 + i % 2}-{item}-{p:04d}", f) for p, c in enumerate(chunks) if (f := udfs.span(quote, c))), (None, None))
        assert have[i] == want and (not t.isascii() or want[1] is None or want[1] == literal(quote, t))


def test_best_lines(spark, table):
    def score(quote, line):
        words = lambda t: set(re.findall(r"[^\W\d_]{3,}", form(t)))
        figures = lambda t: {d for d in (re.sub(r"\D", "", n) for n in re.findall(r"\d[\d.,]*%?", t)) if not (len(d) == 4 and 1900 <= int(d) <= 2100)}
        a, b, m, n = words(quote), words(line), figures(quote), figures(line)
        coverage, alike = len(a & b) / max(1, min(len(a), len(b))), round(difflib.SequenceMatcher(None, form(quote), form(line)).ratio(), 9)
        return (len(m & n), len(a & b), coverage, alike) if (m & n and a & b) or (not m and len(a & b) >= 4 and coverage >= 0.5 and alike >= 0.4) else None

    want = {}
    for i, t in table("documents", "doc_id, text"):
        scored = [(s, x.strip()) for x in t.splitlines() if x.strip() and (s := score(t[:80], x.strip()))]
        if scored:
            best = [x for s, x in scored if s == max(scored)[0]]
            want[i] = best[0] if len(best) == 1 else None
    assert {r.doc_id: r.line for r in QUERIES["best_literal_line"](spark, DIR).collect()} == want
