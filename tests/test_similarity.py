"""Matching blocks are looked for only where lengths and plain containment don't settle a similarity."""

import random
from difflib import SequenceMatcher

from quaestor.functions import udfs
from quaestor.operators import evidence


def test_ratio_is_that_of_matching_blocks(monkeypatch):
    rng, pairs = random.Random(4), [("", ""), ("", "a"), ("a", "")]
    for n in (1, 5, 40, 80, 150, 199, 200, 201, 400):
        b = "".join(rng.choice("abc d") for _ in range(n))
        at = rng.randrange(n)
        pairs += [(b, b), (b[: n // 2 + 1], b), (b, b[: n // 2 + 1]), (b[at : at + 30], b), (b, b[at:]), (b[::-1], b), (b + "x", "y" + b)]
    assert [udfs.ratio(a, b) for a, b in pairs] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    monkeypatch.setattr(udfs, "SequenceMatcher", None)
    assert udfs.ratio("abc", "xabcx") == udfs.ratio("xabcx", "abc") == 0.75


def test_lines_too_long_to_be_alike_are_not_compared(spark):
    quote = "alpha beta gamma delta epsilon"
    rows = [(quote, quote + " zeta"), (quote, quote + " word" * 40), (quote + " 7", "7 alpha" + " word" * 60)]
    found = evidence.scored_lines(spark.createDataFrame(rows, "quote string, line string"), "quote", "line")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "length(" in plan and plan.count(r"\p{L}{3,}") == 2  # words are found once for a quote and once for a line
    below = plan[plan.rindex("ArrowEvalPython") :]
    assert "Filter" in below and "length(" in below  # the filter comes before the last, that is the first, step in Python
    got = {r.line: r.score.similarity for r in found.collect()}
    assert got == {line: round(SequenceMatcher(None, q, line).ratio(), 9) for q, line in (rows[0], rows[2])}
