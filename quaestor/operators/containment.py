"""Which texts hold which shorter texts, by keys that a holder must have; no text is tried without a shared key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.sources.tables import stored

#: Words, or characters, of a key at most.
WORDS, CHARACTERS = 4, 4


def _spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", " ")


def containing(questions: DataFrame, docs: DataFrame, form: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(query_id, doc_id) of questions (query_id, text) that stand in documents (doc_id, body), both in a `form`.

    A question's first and last word may be parts of a document's, those between stand in it whole: a run of them, as many
    as it has up to WORDS, is its key, and a document's are its runs of the lengths that some question has. A
    question of one or two words has its first characters as a key. Pairs with a key in common are held against the whole
    texts. The empty question stands in every document; null texts hold nothing and stand in nothing.
    """
    q = questions.select("query_id", form(F.col("text")).alias("q")).withColumn("words", F.split(_spaced(F.col("q")), " ")).withColumn("inner", F.size("words") - 2)
    q = q.withColumn("by_words", F.col("inner") > 0).withColumn("n", F.when(F.col("by_words"), F.least("inner", F.lit(WORDS))).otherwise(F.least(F.length("q"), F.lit(CHARACTERS))))
    key = F.when(F.col("by_words"), F.xxhash64(F.slice("words", F.lit(2), F.col("n")))).otherwise(F.xxhash64(F.lit(True), F.substring(_spaced(F.col("q")), F.lit(1), F.col("n"))))
    asked = stored(q.where("n > 0").select("query_id", "q", "by_words", "n", key.alias("key")), "asked")
    kinds = asked.select("by_words", "n").distinct().collect()  # at most WORDS + CHARACTERS

    d = docs.select("doc_id", form(F.col("body")).alias("body"))
    spaced = d.select("doc_id", _spaced(F.col("body")).alias("s"))
    parts = []
    for by_words, n in kinds:
        if by_words:
            w = spaced.select("doc_id", F.split("s", " ").alias("w")).where(F.size("w") >= n)
            keys = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, F.lit(n))))  # noqa: B023
        else:
            w = spaced.select("doc_id", F.regexp_extract_all("s", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)).alias("w"))
            keys = F.transform("w", lambda g: F.xxhash64(F.lit(True), g))
        parts.append(w.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")))
    empty = questions.where(form(F.col("text")) == "").select("query_id").join(d.where("body IS NOT NULL").select("doc_id"))
    if not parts:
        return empty
    runs = parts[0]
    for part in parts[1:]:
        runs = runs.unionAll(part)
    # stored, as their size is known then: where they are few, no documents are shuffled to meet them
    pairs = stored(asked.select("query_id", "q", "key").join(runs, "key").select("query_id", "q", "doc_id").distinct(), "candidates")
    held = pairs.join(d, "doc_id").where(F.contains("body", F.col("q"))).select("query_id", "doc_id")
    return held.unionAll(empty)
