"""Places of quotes in texts whose characters become none or several in a skeleton, against a list of all places."""

import random

from quaestor.functions import udfs


def listed(text):
    return [(x, i) for i, c in enumerate(text) for x in c.translate(udfs._QUOTES).casefold() if not x.isspace()]


def test_places_without_a_list():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("aAbBßİ …“–.  \nͅﬁ'«c") for _ in range(rng.randint(0, 60)))
        want = listed(text)
        assert udfs.skeleton(text) == "".join(x for x, _ in want)
        assert [udfs.place(text, n) for n in range(len(want))] == [i for _, i in want]


def test_quotes_are_looked_for_in_whole_texts():
    text = "x " * 50_000 + "The “Straße” was  long… and — narrow at its end"
    assert udfs.span("x the \"STRASSE\" was long", text) == "x The “Straße” was  long"
    assert udfs.span("the \"strasse\" ... narrow at its end", text) == text[100_000:]
