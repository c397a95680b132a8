"""Repair of citations and recovery of structured answers, from what a trace's searches returned and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import numeric as N
from quaestor.functions import text as T
from quaestor.functions import udfs
from quaestor.operators import traces

# What two lines must share.
WORDS, COVERAGE, SIMILARITY = 4, 0.5, 0.4


def numbers(text: Column) -> Column:
    """The different numbers of a text by their digits alone, without years from 1900 to 2100."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d.,]*%?"), F.lit(0)), lambda n: F.regexp_replace(n, r"\D", ""))
    return F.filter(F.array_distinct(found), lambda d: ~((F.length(d) == 4) & d.try_cast("int").between(1900, 2100)))


def quoted(texts: DataFrame, quote: str) -> DataFrame:
    """texts with `_quoted`, a quote's words and numbers: they are found once for all lines that it is then held against."""
    return texts.withColumn("_quoted", F.struct(T.long_words(F.col(quote)).alias("words"), numbers(F.col(quote)).alias("numbers")))


def scored_lines(pairs: DataFrame, quote: str, line: str) -> DataFrame:
    """pairs with `score`: (numbers, words, coverage, similarity) that quote and line share; pairs that aren't alike enough go.

    Enough is a common number and word, or, for a quote without numbers, WORDS common words that are COVERAGE of the shorter's
    and a SIMILARITY of matching blocks. That is computed last, for pairs that the rest leaves and whose lengths allow it.
    """
    p = pairs if "_quoted" in pairs.columns else quoted(pairs, quote)
    held = F.struct(T.long_words(F.col(line)).alias("words"), numbers(F.col(line)).alias("numbers"))
    p = p.select("*", F.explode(F.array(held)).alias("_line"))  # one row: else each condition below finds a line's words again
    own, other = F.col("_quoted.words"), F.col("_line.words")
    p = p.withColumn("_own", F.size(own)).withColumn("_other", F.size(other)).withColumn("_words", F.size(F.array_intersect(own, other)))
    p = p.withColumn("_said", F.size("_quoted.numbers")).withColumn("_numbers", F.size(F.array_intersect("_quoted.numbers", "_line.numbers")))
    p = p.withColumn("_coverage", F.col("_words") / F.greatest(F.lit(1), F.least("_own", "_other")))
    figures = (F.col("_numbers") >= 1) & (F.col("_words") >= 1)
    wording = (F.col("_said") == 0) & (F.col("_words") >= WORDS) & (F.col("_coverage") >= COVERAGE)
    a, b = T.folded(F.col(quote)), T.folded(F.col(line))
    most = 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))  # no more can match than the shorter has
    p = p.where(figures | (wording & (most >= SIMILARITY - 1e-8)))
    p = p.select("*", F.explode(F.array(F.struct(a.alias("a"), b.alias("b")))).alias("_pair"))  # else Spark has all pairs compared, below that filter
    p = p.withColumn("_similarity", F.round(udfs.similarity(F.col("_pair.a"), F.col("_pair.b")), 9)).where(figures | (F.col("_similarity") >= SIMILARITY))
    score = F.struct(F.col("_numbers").alias("numbers"), F.col("_words").alias("words"), F.col("_coverage").alias("coverage"), F.col("_similarity").alias("similarity"))
    return p.withColumn("score", score).drop("_quoted", "_line", "_pair", "_own", "_other", "_words", "_said", "_numbers", "_coverage", "_similarity")


def only_best(scored: DataFrame, key: str) -> DataFrame:
    """The row with the highest score of each key, if no other has as high a one."""
    w = Window.partitionBy(key).orderBy(F.desc("score"))
    top = scored.withColumn("_rank", F.rank().over(w)).where("_rank = 1")
    return top.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_rank", "_n")


def lines(texts: DataFrame, text: str) -> DataFrame:
    """A row for each line of a text that isn't blank, trimmed, with its place `at`."""
    cut = texts.select("*", F.posexplode(F.split(text, r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")).alias("at", "line"))
    return cut.withColumn("line", T.trimmed(F.col("line"))).where("line <> ''")


def repair_citations(said: DataFrame, of: DataFrame, chunks: DataFrame) -> DataFrame:
    """(thread_id, action, cita, chunk_id) for each answer (thread_id, cita, chunk_id) by the chunks that its trace's searches returned.

    of: traces.calls(). chunks: (chunk_id, texto). no_quote: blank or null; no_search: nothing was returned; valid: its chunk was returned
    and holds the quote's start; relinked: exactly one returned chunk holds it, which becomes the chunk; literalised: else, if
    its chunk was returned, that chunk's line that scores best for the quote, if it is alone at the top, becomes the quote;
    unrepaired: neither, and quote and chunk stay. Each step takes only what those before it left.
    """
    a = said.select("thread_id", "cita", "chunk_id").join(of.select("thread_id", F.expr(traces.retrieved()).alias("ids")), "thread_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    blank = T.trimmed(F.coalesce("cita", F.lit(""))) == ""
    a = a.withColumn("action", F.when(blank, "no_quote").when(F.size("ids") == 0, "no_search"))
    open_ = a.where("action IS NULL").drop("action")
    texts = chunks.select(F.col("chunk_id").alias("id"), "texto")
    found = open_.select("thread_id", "cita", "chunk_id", F.explode("ids").alias("id")).join(texts, "id").where(T.supported(F.col("cita"), F.col("texto")))
    found = found.groupBy("thread_id").agg(F.bool_or(F.col("id").eqNullSafe(F.col("chunk_id"))).alias("own"), F.count("*").alias("n"), F.min("id").alias("one"))
    first = open_.join(found, "thread_id", "left").withColumn("action", F.when(F.col("own"), "valid").when(F.col("n") == 1, "relinked"))
    done = first.where("action IS NOT NULL").select("thread_id", "action", "cita", F.when(F.col("action") == "relinked", F.col("one")).otherwise(F.col("chunk_id")).alias("chunk_id"))
    rest = first.where("action IS NULL").select("thread_id", "cita", "chunk_id", "ids")
    held = rest.where(F.array_contains("ids", F.col("chunk_id"))).join(texts, F.col("id") == F.col("chunk_id"))
    best = only_best(scored_lines(lines(held.select("thread_id", "cita", "texto"), "texto"), "cita", "line"), "thread_id").select("thread_id", "line")
    last = rest.join(best, "thread_id", "left").select("thread_id", F.when(F.col("line").isNotNull(), "literalised").otherwise("unrepaired").alias("action"), F.coalesce("line", "cita").alias("cita"), "chunk_id")
    return a.where("action IS NOT NULL").select("thread_id", "action", "cita", "chunk_id").unionAll(done).unionAll(last)


def recoverable(of: DataFrame, structured: DataFrame) -> DataFrame:
    """(thread_id, ids, text, candidates, signals): threads of traces.calls() that ended without a structure but may be given one.

    Their last assistant message makes no calls, their searches returned chunks, and no fact was asked for. candidates are the
    message's text and the arguments that it wrote beside calls; signals the text and the searches' queries.
    """
    last = F.expr("try_element_at(filter(messages, m -> m.role = 'assistant'), -1)")
    t = of.join(structured.select("thread_id"), "thread_id", "left_anti").select("thread_id", "calls", last.alias("last"), F.expr(traces.retrieved()).alias("ids"))
    t = t.where("last IS NOT NULL AND size(last.calls) = 0 AND size(ids) > 0 AND NOT exists(calls, c -> c.name = 'get_xbrl_fact')")
    text = T.trimmed(F.coalesce("last.content", F.lit("")))
    filled = lambda array: F.filter(F.transform(array, lambda x: T.trimmed(x)), lambda x: x != "")
    candidates = F.array_distinct(filled(F.concat(F.array(text), F.coalesce("last.invalid_args", F.array().cast("array<string>")))))
    queries = F.expr("transform(filter(calls, c -> c.name = 'search_filings'), c -> coalesce(try_variant_get(try_parse_json(c.args), '$.query', 'string'), ''))")
    return t.select("thread_id", "ids", text.alias("text"), candidates.alias("candidates"), F.array_distinct(filled(F.concat(F.array(text), queries))).alias("signals"))


def recover_json(open_: DataFrame, chunks: DataFrame) -> DataFrame:
    """(thread_id, udfs.ANSWER): the first candidate of each of recoverable() that is an answer from the text whose returned chunk holds its quote."""
    c = open_.select("thread_id", "ids", F.posexplode("candidates").alias("at", "candidate")).withColumn("a", udfs.parsed_answer("candidate"))
    c = c.where("a.fuente = 'texto' AND a.cita IS NOT NULL AND array_contains(ids, a.chunk_id)")
    held = c.join(chunks.select(F.col("chunk_id").alias("id"), "texto"), F.col("id") == F.col("a.chunk_id")).where(T.supported(F.col("a.cita"), F.col("texto")))
    return held.groupBy("thread_id").agg(F.min_by("a", "at").alias("a")).select("thread_id", "a.*")


def recover(of: DataFrame, structured: DataFrame, chunks: DataFrame) -> DataFrame:
    """(thread_id, how, udfs.ANSWER): structured answers of threads that ended without one, `json` by recover_json, `line` by a unique best line.

    The rest, whose text isn't blank: of all lines of returned chunks the one that scores best for the text or a search's
    query is the quote, if it is alone at the top; the answer is the text, with the chunk's company and year. chunks:
    (chunk_id, ticker, fiscal_year, texto). Threads that neither way recovers have no row.
    """
    open_ = recoverable(of, structured)
    by_json = recover_json(open_, chunks)
    rest = open_.join(by_json.select("thread_id"), "thread_id", "left_anti").where("text <> ''")
    named = chunks.select(F.col("chunk_id").alias("id"), "ticker", "fiscal_year", "texto")
    held = lines(rest.select("thread_id", "signals", F.explode("ids").alias("id")).join(named.select("id", "texto"), "id"), "texto").select("thread_id", "signals", "id", "line").dropDuplicates(["thread_id", "id", "line"])
    scored = scored_lines(held.select("thread_id", "id", "line", F.explode("signals").alias("signal")), "signal", "line")
    best = only_best(scored.groupBy("thread_id", "id", "line").agg(F.max("score").alias("score")), "thread_id")
    by_line = rest.select("thread_id", "text").join(best, "thread_id").join(named.select("id", "ticker", "fiscal_year"), "id")
    nothing = lambda kind: F.lit(None).cast(kind)
    out = by_line.select("thread_id", F.lit("line").alias("how"), F.col("text").alias("respuesta"), nothing("double").alias("cifra"), nothing("string").alias("unidad"), "ticker", F.col("fiscal_year").cast("int").alias("ejercicio"), F.lit("texto").alias("fuente"), F.col("line").alias("cita"), F.col("id").alias("chunk_id"))
    return by_json.select("thread_id", F.lit("json").alias("how"), *udfs.ANSWER_FIELDS).unionAll(out)


def evidence_errors(said: DataFrame, of: DataFrame, consulted: DataFrame, chunks: DataFrame, relative: float = 1e-6) -> DataFrame:
    """(thread_id, errors): why an answer's evidence isn't accepted, an array of codes.

    said: (thread_id, ANSWER's ticker, ejercicio, fuente, cita, chunk_id, cifra, unidad). of: traces.calls(). consulted: (thread_id, ticker,
    fiscal_year, value, unit), facts that the thread's calls got. chunks: (chunk_id, ticker, fiscal_year, texto). An answer from the
    text, or with a chunk or quote: not_literal, its quote isn't in its chunk word for word; not_retrieved, no search
    returned the chunk; identity, the chunk is of another company or year. An answer with a number from facts: number, no
    consulted fact has its unit, company, year and (within `relative`, symmetric) value.
    """
    c = chunks.select("chunk_id", F.col("ticker").alias("of_ticker"), F.col("fiscal_year").alias("of_year"), "texto")
    ids = of.select("thread_id", F.expr(traces.retrieved()).alias("ids"))
    a = said.join(ids, "thread_id", "left").join(c, "chunk_id", "left")
    close = N.close(F.col("cifra"), F.col("value"), relative) & (F.col("unidad") == F.col("unit"))
    backed = said.select("thread_id", "cifra", "unidad", "ticker", F.col("ejercicio").alias("fiscal_year")).join(consulted.select("thread_id", "ticker", "fiscal_year", "value", "unit"), ["thread_id", "ticker", "fiscal_year"]).where(close)
    a = a.join(backed.select("thread_id").distinct().withColumn("backed", F.lit(True)), "thread_id", "left")
    quoting = F.coalesce(F.col("fuente").isin("texto", "ambas"), F.lit(False)) | (F.coalesce("chunk_id", F.lit("")) != "") | (F.coalesce("cita", F.lit("")) != "")
    literal = F.coalesce((F.col("cita") != "") & F.contains("texto", F.col("cita")), F.lit(False))
    named = F.col("ticker").eqNullSafe(F.col("of_ticker")) & F.col("ejercicio").eqNullSafe(F.col("of_year"))
    figure = F.col("cifra").isNotNull() & F.coalesce(F.col("fuente").isin("xbrl", "ambas"), F.lit(False))
    errors = F.array_compact(F.array(
        F.when(quoting & ~literal, "not_literal"), F.when(quoting & ~F.coalesce(F.array_contains("ids", F.col("chunk_id")), F.lit(False)), "not_retrieved"),
        F.when(quoting & F.col("texto").isNotNull() & ~named, "identity"), F.when(figure & F.col("backed").isNull(), "number")))
    return a.select("thread_id", errors.alias("errors"))
