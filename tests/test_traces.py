"""Traces, repaired citations, recovered answers, the number checker, against plain Python on inputs that reach each branch."""

import difflib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quaestor.functions import udfs
from quaestor.operators import evidence, numbers, traces

ID = "AB-2024-1A-%04d"
CHUNKS = [
    (ID % 0, "AB", 2024, "Net sales were 1,234 million this year.\nCosts of goods fell sharply in the second half of it.\n\nOther  matters"),
    (ID % 1, "AB", 2024, "Net sales were 1,234 million this year.\nThe board met seven times\r\nThe board met seven times"),
    (ID % 2, "AB", 2024, "  Straße und Weg A line of words about taxes paid abroad in euros  "),
    (ID % 3, "AB", 2024, "same old line of words here\nsame old line of words here"),
    (ID % 4, "CD", 2023, ""),
]


def rendered(*ids):
    return "\n\n---\n\n".join(f"[{i}] AB FY2024 Item 1A\ntext" for i in ids) or "nothing"


def message(thread, turn, role, **fields):
    base = {"content": None, "calls": None, "invalid_args": None, "call_id": None, "name": None, "status": None, "duration_ms": None, "tokens_in": None, "tokens_out": None, "cost": None}
    return (thread, turn, role, *(base | fields).values())


def search(thread, ids, status="success", query="q"):
    return [message(thread, 1, "assistant", calls=[("s", "search_filings", json.dumps({"query": query}))]), message(thread, 2, "tool", call_id="s", content=rendered(*ids), status=status)]


def of(spark, rows):
    return traces.calls(traces.threads(spark.createDataFrame(rows, traces.MESSAGE)))


def test_calls_and_answers(spark):
    long = "x" * 4001
    rows = [
        message("a", 5, "assistant", content="last", tokens_in=1, tokens_out=2, cost=0.5), message("a", 0, "user", content="ask"),
        message("a", 1, "assistant", content=None, calls=[("1", "search_filings", "{}"), (None, "read_section", "{}"), ("", "list_available", None), ("9", "other", "{}"), ("2", "get_xbrl_fact", "{}"), ("3", "search_filings", "{}")], tokens_in=10, tokens_out=20),
        message("a", 2, "tool", call_id="1", content=rendered(ID % 0), status="error", duration_ms=3.0), message("a", 3, "tool", call_id="1", content=rendered(ID % 1, ID % 2, ID % 1), status="success", duration_ms=4.0),
        message("a", 3, "tool", call_id="read_section-1", content=long), message("a", 4, "tool", call_id="list_available-2", content=rendered(ID % 0), status="success"), message("a", 4, "tool", call_id="3", content=None, status="error"),
        message("b", 0, "user", content="only a question"), message("c", 0, "assistant", calls=[("1", "search_filings", "{}")], content="asks"),
    ]
    got = {r.thread_id: r.calls for r in of(spark, rows).collect()}
    assert [tuple(c) for c in got["a"]] == [
        ("1", "search_filings", "{}", True, None, rendered(ID % 1, ID % 2, ID % 1), [ID % 1, ID % 2, ID % 1], 4.0), ("read_section-1", "read_section", "{}", True, None, "x" * 4000 + traces.CUT, [], 0.0),
        ("list_available-2", "list_available", None, True, None, rendered(ID % 0), [], 0.0), ("2", "get_xbrl_fact", "{}", False, traces.NO_RESULT, None, [], 0.0), ("3", "search_filings", "{}", False, "", None, [], 0.0),
    ]
    assert got["b"] == [] and got["c"][0].error == traces.NO_RESULT
    structured = spark.createDataFrame([("b", "yes", 1.0, "USD", "xbrl", "  ", "c1")], "thread_id string, respuesta string, cifra double, unidad string, fuente string, cita string, chunk_id string")
    a = {r.thread_id: r for r in traces.answers(of(spark, rows), structured).collect()}
    assert (a["a"].respuesta, a["a"].fuente, a["a"].tokens_in, a["a"].tokens_out, a["a"].cost, a["a"].error) == ("last", "ninguna", 11, 22, 0.5, traces.NO_STRUCTURE)
    assert (a["b"].respuesta, a["b"].cita, a["b"].chunk_id, a["b"].tokens_in, a["b"].cost, a["b"].error) == ("yes", None, "c1", None, None, None) and a["c"].respuesta == "asks"


def test_recall_over_the_first_of_each_call(spark):
    chunks = spark.createDataFrame([(i, t) for i, _, _, t in CHUNKS], "chunk_id string, texto string")
    rows = search("first", [ID % 4, ID % 0]) + search("beyond k", [ID % 4, ID % 3, ID % 0]) + search("failed", [ID % 0], "error") + search("unknown chunk", ["ZZ-2024-1A-0000"]) + search("no anchor", [ID % 0]) + search("empty", [])
    rows += [message("twice", 1, "assistant", calls=[("s", "search_filings", "{}"), ("t", "search_filings", "{}")]), message("twice", 2, "tool", call_id="s", content=rendered(ID % 4, ID % 4)), message("twice", 3, "tool", call_id="t", content=rendered(ID % 4, ID % 0))]
    anchors = spark.createDataFrame([(t, None if t == "no anchor" else "Costs of goods fell") for t in ("first", "beyond k", "failed", "unknown chunk", "no anchor", "empty", "twice")], "thread_id string, anchor string")
    out = {r.thread_id: (r.n_chunks, r.recall) for r in traces.anchor_recall(of(spark, rows), anchors, chunks, 2).collect()}
    assert out == {"first": (2, 1.0), "beyond k": (2, 0.0), "failed": (0, 0.0), "unknown chunk": (1, 0.0), "no anchor": (1, 0.0), "empty": (0, 0.0), "twice": (2, 1.0)}


def test_an_answer_as_json():
    good = {"respuesta": "Sí.", "fuente": "texto", "cita": "q", "chunk_id": "c"}
    text = lambda **more: json.dumps(good | more)
    assert udfs.answer(text())["cita"] == "q" and udfs.answer(f"```json\n{text()}\n```") == udfs.answer(f"```{text()}```") == udfs.answer(text())
    assert udfs.answer(text(cifra="2.5", unidad="USD", ejercicio="2024")) | {"cifra": 0} == udfs.answer(text(cifra=0, unidad="USD", ejercicio=2024.0))
    bad = [None, "", "no", "[1]", "{", f"say ```json\n{text()}\n```", text(otro=1), text(respuesta=" "), text(respuesta=None), text(respuesta=3), text(fuente="libro"), text(unidad="USD"), text(cifra="x"), text(cifra=[1]), text(ejercicio=2024.5), text(ejercicio=10**12), text(chunk_id=5), '{"fuente": "texto"}', "[" * 100_000]
    assert [udfs.answer(t) for t in bad] == [None] * len(bad)


# A plain twin of line scores, repair and recovery.


def form(t):
    return re.sub(r"\s+", " ", t).strip().casefold()


def line_score(quote, line):
    words = lambda t: set(re.findall(r"[^\W\d_]{3,}", form(t)))
    figures = lambda t: {d for d in (re.sub(r"\D", "", n) for n in re.findall(r"\d[\d.,]*%?", t)) if not (len(d) == 4 and 1900 <= int(d) <= 2100)}
    a, b, m, n = words(quote), words(line), figures(quote), figures(line)
    coverage, alike = len(a & b) / max(1, min(len(a), len(b))), round(difflib.SequenceMatcher(None, form(quote), form(line)).ratio(), 9)
    if (m & n and a & b) or (not m and len(a & b) >= 4 and coverage >= 0.5 and alike >= 0.4):
        return len(m & n), len(a & b), coverage, alike
    return None


def best_of(scored):
    top = max((s for s, _ in scored), default=None)
    best = [x for s, x in scored if s == top]
    return best[0] if len(best) == 1 else None


def holds(quote, text):
    return bool(form(quote)[:120]) and form(quote)[:120] in form(text)


QUOTES = {
    "no quote": (None, ID % 0, [ID % 0]), "blank": (" \n", ID % 0, [ID % 0]), "no search": ("Net sales", ID % 0, []), "valid": ("NET  sales were", ID % 1, [ID % 0, ID % 1]), "valid by sharp s": ("STRASSE und", ID % 2, [ID % 2]), "relinked": ("costs of goods", ID % 1, [ID % 0, ID % 1]),
    "relinked from none": ("costs of goods", None, [ID % 0]), "two hold it": ("Net sales were 1,234", ID % 2, [ID % 0, ID % 1, ID % 2]), "two hold it, own a line": ("Net sales were 1,234", ID % 3, [ID % 0, ID % 1, ID % 3]), "literalised": ("Net sales, which were 1.234 this year", ID % 0, [ID % 0, ID % 1]),
    "literalised by words": ("Costs of goods have fallen sharply in the second half", ID % 0, [ID % 0]), "tied lines": ("The board has met seven times", ID % 1, [ID % 1]), "tied words": ("same old line of words there", ID % 3, [ID % 3]), "not returned": ("Net sales, which were 1.234", ID % 0, [ID % 1]), "unknown chunk": ("Net sales, 1.234", "ZZ-2024-1A-0000", ["ZZ-2024-1A-0000"]),
    "nothing alike": ("utterly different", ID % 0, [ID % 0]), "empty chunk": ("Net sales", ID % 4, [ID % 4]),
}


def repair_by_hand(quote, chunk, ids):
    texts = {i: t for i, _, _, t in CHUNKS}
    if not (quote or "").strip():
        return "no_quote", quote, chunk
    if not ids:
        return "no_search", quote, chunk
    held = [i for i in ids if i in texts and holds(quote, texts[i])]
    if chunk in held:
        return "valid", quote, chunk
    if len(held) == 1:
        return "relinked", quote, held[0]
    lines = [x.strip() for x in texts.get(chunk, "").splitlines() if x.strip()] if chunk in ids else []
    line = best_of([(s, x) for x in lines if (s := line_score(quote, x))])
    return ("literalised", line, chunk) if line else ("unrepaired", quote, chunk)


def test_citations_are_repaired_or_refused(spark):
    rows = [m for t, (_, _, ids) in QUOTES.items() if ids for m in search(t, ids)]
    said = spark.createDataFrame([(t, q, c) for t, (q, c, _) in QUOTES.items()], "thread_id string, cita string, chunk_id string")
    chunks = spark.createDataFrame([(i, t) for i, _, _, t in CHUNKS], "chunk_id string, texto string")
    out = {r.thread_id: (r.action, r.cita, r.chunk_id) for r in evidence.repair_citations(said, of(spark, rows), chunks).collect()}
    assert out == {t: repair_by_hand(*x) for t, x in QUOTES.items()}
    assert {x[0] for x in out.values()} == {"no_quote", "no_search", "valid", "relinked", "literalised", "unrepaired"}


def test_answers_are_recovered_or_refused(spark):
    said = lambda **f: json.dumps({"respuesta": "Yes.", "fuente": "texto", "cita": "Costs of goods", "chunk_id": ID % 0} | f)
    ends = {
        "json": said(), "fenced": f"```json\n{said(cifra=3, unidad='USD', ejercicio=2024)}\n```", "other source": said(fuente="xbrl"), "other chunk": said(chunk_id=ID % 2), "not in it": said(cita="nowhere at all"), "no quote": said(cita=None),
        "line": " Costs of goods did fall sharply in the second half ", "tied": "Net sales were 1,234 million this year.", "nothing": "Hello", "blank": "  ", "none": None,
    }
    rows = [m for t, end in ends.items() for m in [*search(t, [ID % 0, ID % 1]), message(t, 9, "assistant", content=end)]]
    rows += [*search("by query", [ID % 2, ID % 4], query="words about the taxes paid abroad"), message("by query", 9, "assistant", content="No idea")]
    rows += [*search("beside", [ID % 0]), message("beside", 9, "assistant", content="see", invalid_args=["", "{", said(respuesta="Beside.")])]
    rows += [*search("calls", [ID % 0]), message("calls", 9, "assistant", content=said(), calls=[("z", "list_available", "{}")])]
    rows += [*search("fact", [ID % 0]), message("fact", 3, "assistant", calls=[("f", "get_xbrl_fact", "{}")]), message("fact", 9, "assistant", content=said())]
    rows += [*search("failed", [ID % 0], "error"), message("failed", 9, "assistant", content=said()), *search("has one", [ID % 0]), message("has one", 9, "assistant", content=said()), message("silent", 0, "user", content="?")]
    structured = spark.createDataFrame([("has one",)], "thread_id string")
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, ticker string, fiscal_year int, texto string")
    out = {r.thread_id: r for r in evidence.recover(of(spark, rows), structured, chunks).collect()}
    assert {t: r.how for t, r in out.items()} == {"json": "json", "fenced": "json", "line": "line", "by query": "line", "beside": "json"}
    assert out["beside"].respuesta == "Beside." and (out["fenced"].cifra, out["fenced"].ejercicio) == (3.0, 2024)
    assert tuple(out["line"])[2:] == (ends["line"].strip(), None, None, "AB", 2024, "texto", "Costs of goods fell sharply in the second half of it.", ID % 0)
    assert (out["by query"].cita, out["by query"].chunk_id, out["by query"].respuesta) == ("A line of words about taxes paid abroad in euros", ID % 2, "No idea")


# The number checker.


def near(c, v, tolerance):
    return c == 0 if v == 0 else abs(c - v) / abs(v) <= tolerance


@pytest.mark.parametrize("tolerance", [0.0, 1e-6, 0.01, 0.5])
def test_band_join_equals_all_pairs(spark, tolerance):
    rng = random.Random(4)
    some = [0.0, -0.0, 1.0, -1.0, 100.0, 101.0, 99.0, 1e-300, 1e300, 5e-324] + [rng.choice((-1, 1)) * 10 ** rng.uniform(-3, 3) for _ in range(80)]
    claims = [(i, "k" if i % 2 else None, x) for i, x in enumerate([*some, *(x * (1 + tolerance * rng.choice((1, -1, 0.999, 1.001))) for x in some), float("nan"), float("inf")])] + [(999, "k", None)]
    values = [(i, "k" if i % 3 else None, x) for i, x in enumerate([*some, float("inf"), float("nan")])] + [(998, "k", None)]
    out = numbers.band_join(spark.createDataFrame(claims, "c long, key string, claimed double"), spark.createDataFrame(values, "v long, key string, value double"), ["key"], "claimed", "value", tolerance)
    want = sorted((a, b) for a, k, c in claims for b, o, v in values if k == o == "k" and c is not None and v is not None and math.isfinite(c) and math.isfinite(v) and near(c, v, tolerance))
    assert sorted((r.c, r.v) for r in out.collect()) == want
    with pytest.raises(ValueError):
        numbers.band_join(out, out, ["key"], "claimed", "value", 1.0)


def test_every_verdict_on_a_number(spark):
    facts = [("AB", 2023, "Sales", 100.0, "USD"), ("AB", 2024, "Sales", 150.0, "USD"), ("AB", 2024, "Income", 30.0, "USD"), ("AB", 2024, "EPS", 7.46, "USD/shares"), ("AB", 2024, "Staff", 7000.0, "people"), ("CD", 2024, "Sales", 900.0, "EUR"), ("AB", 2024, "Sold", 150.5, "pieces"), ("AB", 2024, "Zero", 0.0, "USD")]
    asked = {"all": facts[:4], "two units": [facts[1], facts[6]], "zero": [facts[7], facts[1]], "other": [facts[5], facts[0]], "none": []}
    a = {
        1: ("all", 150.9, " ab ", 2024, "usd", False, "match", "AB/2024/Sales", "usd"), 2: ("all", 150.0, None, None, "dólares", False, "unit_normalised", "AB/2024/Sales", "USD"), 3: ("two units", 150.2, "AB", 2024, "x", False, "match", "AB/2024/Sales", "x"), 4: ("all", 50.0, "AB", 2024, None, False, "derived", None, None),
        5: ("all", -33.3, "AB", 2024, None, False, "derived", None, None), 6: ("all", 20.0, "AB", 2024, None, True, "derived", None, None), 7: ("all", 7.0, "AB", 2024, None, False, "rounded", "AB/2024/EPS", None), 8: ("all", 7.0, "AB", 2024, None, True, "kept", None, None),
        9: ("other", 900.0, "AB", 2024, "EUR", False, "other_identity", "CD/2024/Sales", "EUR"), 10: ("all", 100.0, "AB", 2024, None, False, "other_identity", "AB/2023/Sales", None), 11: ("all", 1.5, "ZZ", 2024, None, False, "no_facts", None, None), 12: ("all", 1.5, "AB", 1990, None, False, "no_facts", None, None),
        13: ("all", 7000.0, "AB", 2024, None, False, "unconsulted", "AB/2024/Staff", None), 14: ("none", 150.0, "AB", 2024, None, False, "unconsulted", "AB/2024/Sales", None), 15: ("all", 7000.0, "AB", None, None, False, "no_match", None, None), 16: ("all", 12345.0, "AB", 2024, None, False, "no_match", None, None),
        17: ("all", None, "AB", 2024, None, True, "no_number", None, None), 18: ("all", float("nan"), "AB", 2024, None, False, "no_number", None, None), 19: ("zero", 0.0, "AB", 2024, "USD", False, "match", "AB/2024/Zero", "USD"), 20: ("all", 7.46, " ", None, None, False, "unit_normalised", "AB/2024/EPS", "USD/shares"), 21: ("none", 5.0, "AB", 2024, None, False, "no_match", None, None),
    }
    answers = spark.createDataFrame([(q, *x[1:6]) for q, x in a.items()], "question_id long, claimed double, ticker string, fiscal_year long, unit string, corrected boolean")
    consulted = spark.createDataFrame([(q, *f) for q, x in a.items() for f in [*asked[x[0]], *asked[x[0]][:1]]], "question_id long, ticker string, fiscal_year long, concept string, value double, unit string")
    out = numbers.check(answers, consulted, spark.createDataFrame(facts, "ticker string, fiscal_year long, concept string, value double, unit string"))
    assert {r.question_id: (r.verdict, r.fact, r.unit) for r in out.collect()} == {q: x[6:] for q, x in a.items()}
    assert {x[6] for x in a.values()} == {"match", "unit_normalised", "derived", "kept", "rounded", "other_identity", "no_facts", "unconsulted", "no_match", "no_number"}
