"""A chain of changed passages from several documents is held against each of them."""

import random

from quaestor.llm import passages


def test_a_chain_keeps_every_document_that_it_is_like(spark):
    rng = random.Random(11)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    changed = lambda words, every: [w if i % every != every // 2 else f"new{i}" for i, w in enumerate(words)]
    rows, want = [], {}
    for k in range(6):
        long, short = say(200), say(70)
        rows += [(10 * k, " ".join(say(30) + long + say(30))), (10 * k + 1, " ".join(say(30) + short + say(30)))]
        rows.append((10 * k + 2, " ".join(say(40) + changed(long, 40) + changed(short, 46) + say(40))))
        want[10 * k + 2] = (10 * k, 10 * k + 1)
    found = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.word_from, r.word_to))
    # the second passage, from word 240 to 310, which is like a document that has fewer of the chain's runs
    covered = [d for d in want if any(low <= 250 and high >= 300 for low, high in found.get(d, []))]
    assert len(covered) >= 5 and found.keys() <= want.keys()
