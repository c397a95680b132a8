"""Cutting sections into chunks, and checking cuts."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text as T

WORD = r"[^\x20\x09-\x0D]+"


def character_windows(sections: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of `size` characters every `step`, until the section's end is covered; ids by position."""
    length = F.length("texto")
    last = F.floor(F.greatest(length - 1 - (size - step), F.lit(0)) / step).cast("int")
    c = sections.where(length > 0).withColumn("posicion", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("posicion") * step
    c = c.withColumn("texto", F.substring("texto", start + 1, F.lit(size))).withColumn("inicio_car", start.cast("long")).withColumn("posicion", F.col("posicion").cast("long"))
    return c.withColumn("fin_car", F.col("inicio_car") + F.length("texto")).withColumn("chunk_id", T.chunk_id(F.col("ticker"), F.col("fiscal_year"), F.col("item"), F.col("posicion")))


def word_windows(sections: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of `size` words that share `overlap` with the next; `words` are a window's own."""
    w = sections.withColumn("all", F.regexp_extract_all("texto", F.lit(WORD), F.lit(0))).where("size(all) > 0").drop("texto")
    count = F.greatest(F.ceil((F.size("all") - overlap) / F.lit(float(size - overlap))), F.lit(1)).cast("long")
    c = w.withColumn("posicion", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return c.withColumn("words", F.slice("all", (F.col("posicion") * (size - overlap) + 1).cast("int"), F.lit(size))).drop("all")


def check_cuts(text: str, cuts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cuts (start, end) of a text that are in order, inside it, none twice, and leave out nothing but white space; else ValueError."""
    found = [(int(a), int(b)) for a, b in cuts]
    if text.strip() and not found:
        raise ValueError("a text with words has no cuts")
    covered = 0
    for i, (a, b) in enumerate(found):
        if not 0 <= a < b <= len(text):
            raise ValueError(f"the cut {a}:{b} isn't inside the text or is empty")
        if i and a < found[i - 1][0]:
            raise ValueError(f"the cut {a}:{b} starts before the one that comes first")
        if i and (a, b) == found[i - 1]:
            raise ValueError(f"the cut {a}:{b} comes twice")
        if a > covered and text[covered:a].strip():
            raise ValueError(f"the text from {covered} to {a} is in no cut")
        covered = max(covered, b)
    if found and text[covered:].strip():
        raise ValueError(f"the text from {covered} on is in no cut")
    return found


def cut_by(sections: DataFrame, cutter: Callable[[str], Iterable[tuple[int, int]]]) -> DataFrame:
    """Chunks of sections (doc_id, ticker, fiscal_year, item, texto) by a plugged-in function from a text to its cuts (start, end).

    The cutter runs as a Python table function over Arrow batches, beside each section; it is asked for one text. Its cuts are
    checked (check_cuts), and a bad one fails the job with the section's number. Null texts have no chunks.
    """
    try:
        inspect.signature(cutter).bind("text")
    except TypeError as wrong:
        raise TypeError("a cutter takes one text") from wrong

    class Cuts:
        def eval(self, doc_id: int, text: str):
            try:
                cuts = check_cuts(text or "", cutter(text or ""))
            except ValueError as wrong:
                raise ValueError(f"section {doc_id}: {wrong}") from wrong
            for i, (a, b) in enumerate(cuts):
                yield i, a, b, text[a:b]

    table = F.udtf(Cuts, returnType="posicion long, inicio_car long, fin_car long, trozo string", useArrow=True)
    of = sections.select("doc_id", "ticker", "fiscal_year", "item", "texto")
    cut = of.lateralJoin(table(F.col("doc_id").outer(), F.col("texto").outer())).withColumn("texto", F.col("trozo")).drop("trozo")
    return cut.withColumn("chunk_id", T.chunk_id(F.col("ticker"), F.col("fiscal_year"), F.col("item"), F.col("posicion")))


def whole_sections(sections: DataFrame) -> DataFrame:
    """One chunk for each section; a table is told by a vertical bar."""
    c = sections.withColumn("posicion", F.lit(0)).withColumn("inicio_car", F.lit(0).cast("long")).withColumn("fin_car", F.length("texto").cast("long"))
    return c.withColumn("contiene_tabla", F.contains("texto", F.lit("|"))).withColumn("chunk_id", T.chunk_id(F.col("ticker"), F.col("fiscal_year"), F.col("item"), F.col("posicion")))


def gaps(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, gap_from, gap_to): stretches between chunks that hold more than spaces."""
    w = Window.partitionBy("doc_id").orderBy("inicio_car").rowsBetween(Window.unboundedPreceding, -1)
    m = chunks.select("doc_id", "inicio_car", F.max("fin_car").over(w).alias("covered")).where("inicio_car > covered")
    gap = F.col("texto").substr((F.col("covered") + 1).cast("int"), (F.col("inicio_car") - F.col("covered")).cast("int"))
    return m.join(sections, "doc_id").where(F.trim(gap) != "").select("doc_id", F.col("covered").alias("gap_from"), F.col("inicio_car").alias("gap_to"))


def contiguity(chunks: DataFrame) -> DataFrame:
    """(doc_id, contiguous, n): whether positions count from 0 in order of start."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("inicio_car")) - 1
    return chunks.select("doc_id", (place == F.col("posicion")).alias("ok")).groupBy("doc_id").agg(F.bool_and("ok").alias("contiguous"), F.count("*").alias("n"))


def validate(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, in_order, unique_spans, in_bounds) for the cuts of each document."""
    before = F.lag("inicio_car").over(Window.partitionBy("doc_id").orderBy("posicion"))
    same = F.count("*").over(Window.partitionBy("doc_id", "inicio_car", "fin_car"))
    c = chunks.select("doc_id", "posicion", "inicio_car", "fin_car").join(sections.select("doc_id", F.length("texto").alias("total")), "doc_id")
    c = c.select("doc_id", "inicio_car", "fin_car", "total", F.coalesce(before < F.col("inicio_car"), F.lit(True)).alias("ordered"), same.alias("same"))
    return c.groupBy("doc_id").agg(F.bool_and("ordered").alias("in_order"), (F.max("same") == 1).alias("unique_spans"), F.bool_and((F.col("fin_car") <= F.col("total")) & (F.col("inicio_car") >= 0)).alias("in_bounds"))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): SHA-256 over `id|text` lines in order of position."""
    line = F.concat("chunk_id", F.lit("|"), "texto", F.lit("\n"))
    return chunks.groupBy("doc_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("posicion", line.alias("line"))))["line"], ""), 256).alias("fingerprint"))
