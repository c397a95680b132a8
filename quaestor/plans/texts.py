"""Text and number functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.functions import numeric as N
from quaestor.functions import text as T
from quaestor.operators import golden

from . import views as V
from .registry import query

# Quotes: parts of documents, some in lower case, some with other spaces, some altered; matched with their documents.
_QUOTE = """quotes AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN substring(text, 11, 150) WHEN 1 THEN lower(substring(text, 11, 60)) WHEN 2 THEN replace(substring(text, 11, 60), ' ', '  ') ELSE substring(text, 11, 40) || ' zzz' END AS quote FROM documents)"""
_FOLD = "replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
_LOWER = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def _quotes(spark, sf_dir):
    part = lambda n: F.substring("text", 11, n)
    quote = F.when(F.col("doc_id") % 4 == 0, part(150)).when(F.col("doc_id") % 4 == 1, F.lower(part(60))).when(F.col("doc_id") % 4 == 2, F.replace(part(60), F.lit(" "), F.lit("  "))).otherwise(F.concat(part(40), F.lit(" zzz")))
    return V.table(spark, sf_dir, "documents").select("doc_id", "text", quote.alias("quote"))


def _messages(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations")


@query(f"WITH {_QUOTE} SELECT doc_id, length({_FOLD.format('quote')}) > 0 AND contains({_FOLD.format('text')}, substring({_FOLD.format('quote')}, 1, 120)) AS supported FROM quotes")
def quote_prefix_match(spark, sf_dir):
    """H01, H03."""
    return _quotes(spark, sf_dir).select("doc_id", T.supported(F.col("quote"), F.col("text")).alias("supported"))


@query(f"WITH {_QUOTE} SELECT doc_id, length({_FOLD.format('quote')}) > 0 AND contains({_FOLD.format('text')}, {_FOLD.format('quote')}) AS literal FROM quotes")
def quote_full_match(spark, sf_dir):
    """H04."""
    return _quotes(spark, sf_dir).select("doc_id", T.supported(F.col("quote"), F.col("text"), None).alias("literal"))


@query(f"WITH {_QUOTE} SELECT doc_id, {_LOWER.format('quote')} AS lowered, lower(trim('  ' || 'Usd ')) = lower(trim('USD')) AS same_unit FROM quotes")
def lower_normalize(spark, sf_dir):
    """H02, H24."""
    return _quotes(spark, sf_dir).select("doc_id", T.lowered(F.col("quote")).alias("lowered"), (F.lower(F.trim(F.lit("  Usd "))) == F.lower(F.trim(F.lit("USD")))).alias("same_unit"))


@query(r"SELECT doc_id, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'))::BIGINT AS n, coalesce(list_extract(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), 1), '') AS first_word FROM documents")
def word_tokens(spark, sf_dir):
    """H06."""
    w = T.word_tokens(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.coalesce(F.get(w, 0), F.lit("")).alias("first_word"))


@query(r"""WITH p AS (SELECT a.conv_id, a.turn, replace(lower(trim(regexp_replace(a.text, '\s+', ' ', 'g'))), 'ß', 'ss') AS x, replace(lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))), 'ß', 'ss') AS y, a.text AS ta, b.text AS tb FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)
SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(x, '\p{L}{3,}')), list_distinct(regexp_extract_all(y, '\p{L}{3,}'))))::BIGINT AS common_words,
len(list_intersect(list_filter(list_distinct(regexp_extract_all(ta, '[0-9]+')), lambda d: NOT (length(d) = 4 AND d BETWEEN '1900' AND '2100')), list_filter(list_distinct(regexp_extract_all(tb, '[0-9]+')), lambda d: NOT (length(d) = 4 AND d BETWEEN '1900' AND '2100'))))::BIGINT AS common_numbers FROM p""")
def word_overlap(spark, sf_dir):
    """Words and numbers that neighbouring messages share."""
    m = _messages(spark, sf_dir)
    nxt = m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    both = m.join(nxt, ["conv_id", "turn"])
    size = lambda f: F.size(F.array_intersect(f(F.col("text")), f(F.col("reply")))).cast("long")
    return both.select("conv_id", "turn", size(T.long_words).alias("common_words"), size(T.number_groups).alias("common_numbers"))


@query("""WITH q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '“' || substring(text, 1, 30) || '”' WHEN 1 THEN '"...' || substring(text, 1, 30) || '..."' ELSE trim(substring(text, 1, 30)) END AS quote FROM documents),
b AS (SELECT doc_id, trim(quote) AS a, regexp_replace(trim(quote), '^["“”''«»]+|["“”''«»]+$', '', 'g') AS bare FROM q), c AS (SELECT doc_id, a, bare, trim(regexp_replace(bare, '^(\\.\\.\\.|…)+|(\\.\\.\\.|…)+$', '', 'g')) AS c FROM b)
SELECT doc_id, a || CASE WHEN bare <> a THEN '|' || bare ELSE '' END || CASE WHEN c <> a AND c <> bare THEN '|' || c ELSE '' END AS variants FROM c""".replace("\\\\", "\\"))
def quote_variants(spark, sf_dir):
    """H13."""
    s = F.substring("text", 1, 30)
    q = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("“"), s, F.lit("”"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"...'), s, F.lit('..."'))).otherwise(F.trim(s))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.quote_variants(q), "|").alias("variants"))


_SKEL = r"""replace(lower(regexp_replace(translate(replace({0}, '…', '...'), '“”„«»‘’‚‹›–—−', repeat('"', 5) || repeat(chr(39), 5) || '---'), '\s+', '', 'g')), 'ß', 'ss')"""


@query(f"""WITH {_QUOTE}, t AS (SELECT doc_id, text, replace(replace(quote, ' ', '   '), '-', '–') AS quote FROM quotes) SELECT doc_id, contains({_SKEL.format('text')}, {_SKEL.format('quote')}) AS found FROM t""")
def typographic_match(spark, sf_dir):
    """H11."""
    q = F.replace(F.replace("quote", F.lit(" "), F.lit("   ")), F.lit("-"), F.lit("–"))
    return _quotes(spark, sf_dir).select("doc_id", F.contains(T.skeleton(F.col("text")), T.skeleton(q)).alias("found"))


@query(f"SELECT doc_id, md5(translate({_FOLD.format('text')}, '{T.ACCENTED}', '{T.PLAIN}')) AS digest FROM documents")
def accent_fold(spark, sf_dir):
    """H14."""
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.unaccented(F.col("text"))).alias("digest"))


_ASKS = ("¿Cómo evolucionó el margen entre 2023 y FY 2024?", "Ingresos FY2023 vs. FY2024", "Variación de los ingresos, 2022 frente a 2023", "Ingresos en 2023 y en 2024")
ASK = "asks AS (SELECT item_id, CASE item_id % 5 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(_ASKS)) + " ELSE text END AS question FROM benchmark)"
_PLAIN = f"translate({_FOLD.format('question')}, '{T.ACCENTED}', '{T.PLAIN}')"
#: Whether a question `q` in plain form is comparative.
COMPARATIVE = f"(regexp_matches(q, '{T.RELATED_PERIODS}') OR regexp_matches(q, '{T.VERSUS_PERIODS}') OR (len(regexp_extract_all(q, '{T.PERIOD}')) >= 2 AND regexp_matches(q, '{T.CHANGE}')))"
ASKED_PLAINLY = f"{ASK}, plain_asks AS (SELECT item_id, {_PLAIN} AS q FROM asks)"


def asks(spark, sf_dir):
    ask = F.col("text")
    for i, q in enumerate(_ASKS):
        ask = F.when(F.col("query_id") % 5 == i, q).otherwise(ask)
    return V.questions(spark, sf_dir).select(F.col("query_id").alias("item_id"), ask.alias("question"))


@query(f"WITH {ASKED_PLAINLY} SELECT item_id, {COMPARATIVE} AS comparative FROM plain_asks")
def comparative_questions(spark, sf_dir):
    """H15."""
    return asks(spark, sf_dir).select("item_id", T.comparative(F.col("question")).alias("comparative"))


_SAID = ("La cifra no está disponible", "Not available in the filings", "Sin información; fuera del corpus", "Ingresos de 5 millones", "Dato: N/A")


@query("SELECT conv_id, turn, regexp_matches(lower(CASE turn % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SAID)) + f" ELSE text END), '{T.NO_ANSWER}') AS none FROM conversations")
def no_answer_marker(spark, sf_dir):
    """H16."""
    m = F.col("text")
    for i, x in enumerate(_SAID):
        m = F.when(F.col("turn") % 6 == i, x).otherwise(m)
    return _messages(spark, sf_dir).select("conv_id", "turn", T.no_answer(m).alias("none"))


@query(f"WITH {V.CHUNKS} SELECT chunk_id, regexp_full_match(chunk_id, '{T.CHUNK_ID}') AS valid, regexp_replace(chunk_id, '-[^-]*$', '-0000') AS parent FROM chunks")
def chunk_id_parts(spark, sf_dir):
    """H17, C16."""
    c = V.chunks(spark, sf_dir).select("chunk_id")
    return c.select("chunk_id", F.col("chunk_id").rlike(f"^{T.CHUNK_ID}$").alias("valid"), T.parent_id(F.col("chunk_id")).alias("parent"))


@query("SELECT doc_id, left(text, 4000) || CASE WHEN length(text) > 4000 THEN '…' ELSE '' END AS shown, list_slice(string_split(text, ' '), 1, 3) AS first_three FROM documents")
def truncate_list(spark, sf_dir):
    """F05, H19."""
    return V.table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text")).alias("shown"), F.slice(F.split("text", " "), 1, 3).alias("first_three"))


@query(r"""WITH y AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'FY2024' WHEN 1 THEN '2023' WHEN 2 THEN '2022.0' WHEN 3 THEN 'fy 2021 ' ELSE 'true' END AS raw FROM benchmark) SELECT item_id, raw, try_cast(regexp_extract(upper(trim(raw)), '^(?:FY\s*)?(\d{4})(?:\.0+)?$', 1) AS INTEGER) AS fiscal_year FROM y""")
def fiscal_year_parse(spark, sf_dir):
    """H20."""
    n = F.col("query_id") % 5
    raw = F.when(n == 0, "FY2024").when(n == 1, "2023").when(n == 2, "2022.0").when(n == 3, "fy 2021 ").otherwise("true")
    return V.questions(spark, sf_dir).select(F.col("query_id").alias("item_id"), raw.alias("raw"), T.fiscal_year(raw).alias("fiscal_year"))


_ERRORS = ("API error, status code: 429", "Rate limit exceeded", "BadRequestResponseError: Provider returned error", "BadRequestResponseError: no such field", "ErrorProveedorAgotadoError")
ERROR = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ERRORS)) + " END"
_MARKS = " OR ".join(f"contains(low, '{m}')" for m in (*T.RATE_LIMIT, T.PROVIDER_GONE))
#: Whether an error `low`, in lower case, passes by itself.
PASSING = f"coalesce({_MARKS} OR (contains(low, '{T.PROVIDER_ERROR[0]}') AND contains(low, '{T.PROVIDER_ERROR[1]}')), false)"


def error_of(event):
    said = F.lit(None).cast("string")
    for i, x in enumerate(_ERRORS):
        said = F.when(event % 6 == i, x).otherwise(said)
    return said


@query(f"WITH e AS (SELECT event_id, lower({ERROR}) AS low FROM events) SELECT event_id, {PASSING} AS transient FROM e")
def transient_errors(spark, sf_dir):
    """H21."""
    return V.table(spark, sf_dir, "events").select("event_id", T.transient_error(error_of(F.col("event_id"))).alias("transient"))


@query(r"""WITH a AS (SELECT doc_id, text, 5 AS low, 5 + 20 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS high, CASE WHEN doc_id % 5 = 0 THEN replace(substring(text, 6, 20), ' ', '_') ELSE substring(text, 6, 20) END AS anchor FROM documents)
SELECT doc_id, substring(text, low + 1, high - low) = anchor AS same, high - low = length(anchor) AS spans, len(regexp_split_to_array(trim(text), '[\x20\x09-\x0D]+')) <= 40 AS short FROM a""")
def anchor_slice_check(spark, sf_dir):
    """An anchor stands at its offsets, these span its length, and a text has at most 40 words."""
    n = F.col("doc_id")
    at = F.substring("text", 6, 20)
    a = V.table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(5).alias("low"), (25 + F.when(n % 7 == 0, 1).otherwise(0)).alias("high"), F.when(n % 5 == 0, F.replace(at, F.lit(" "), F.lit("_"))).otherwise(at).alias("anchor"))
    span = F.col("high") - F.col("low")
    return a.select("doc_id", (F.col("text").substr(F.col("low") + 1, span) == F.col("anchor")).alias("same"), (span == F.length("anchor")).alias("spans"), (F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")) <= 40).alias("short"))


@query(r"""WITH m AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE ' ' || props END AS raw FROM events) SELECT event_id, (CASE WHEN regexp_extract(raw, '(?is)```(?:json)?\s*(.*?)\s*```', 1) <> '' THEN regexp_extract(raw, '(?is)```(?:json)?\s*(.*?)\s*```', 1) ELSE trim(raw) END::JSON ->> 'k')::BIGINT AS k FROM m""")
def fenced_json(spark, sf_dir):
    """An object out of a fenced block."""
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit(" "), "props"))
    return V.table(spark, sf_dir, "events").select("event_id", F.from_json(T.fenced_json(raw), "k long")["k"].alias("k"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, props::JSON ->> 'missing' AS missing FROM events")
def json_args(spark, sf_dir):
    """J01, A02."""
    v = F.try_parse_json("props")
    return V.table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("WITH w AS (SELECT conv_id, unnest(string_split(role || ' ' || role || ' t' || (turn % 2), ' ')) AS w, turn FROM conversations), n AS (SELECT conv_id, w, min(turn * 10 + CASE WHEN w LIKE 't%' THEN 2 ELSE 0 END) AS pos FROM w GROUP BY ALL) SELECT conv_id, string_agg(w, ',' ORDER BY pos) AS seen FROM n GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    """Each once, in the order first seen."""
    m = _messages(spark, sf_dir).select("conv_id", F.struct("turn", F.split(F.concat(F.col("role"), F.lit(" "), F.col("role"), F.lit(" t"), (F.col("turn") % 2).cast("string")), " ").alias("w")).alias("s"))
    return m.groupBy("conv_id").agg(F.array_join(F.array_distinct(F.flatten(F.sort_array(F.collect_list("s"))["w"])), ",").alias("seen"))


# Numbers.
_C = f"WITH {V.CLAIMS}, pairs AS (SELECT c.*, f.value FROM claims c JOIN facts f ON f.ticker = c.ticker AND f.fiscal_year = c.fiscal_year AND f.concept = c.concept)"


def _pairs(spark, sf_dir):
    f = V.facts(spark, sf_dir).select("ticker", "fiscal_year", "concept", "value")
    return V.claims(spark, sf_dir).join(f, ["ticker", "fiscal_year", "concept"])


@query(_C + " SELECT claim_id, CASE WHEN value = 0 THEN claimed = 0 ELSE abs(claimed - value) / abs(value) <= 0.01::DOUBLE END AS within FROM pairs")
def tolerance_one_sided(spark, sf_dir):
    """N02."""
    return _pairs(spark, sf_dir).select("claim_id", N.within_one_sided(F.col("claimed"), F.col("value"), 0.01).alias("within"))


@query(_C + " SELECT claim_id, abs(claimed - value) <= 0.01::DOUBLE * greatest(abs(claimed), abs(value)) AND lower(trim(CASE kind WHEN 1 THEN ' ' || upper(unit) || ' ' WHEN 3 THEN 'EUR' ELSE unit END)) = lower(trim(unit)) AS correct FROM pairs")
def number_correct(spark, sf_dir):
    """N03, H24."""
    said = F.when(F.col("kind") == 1, F.concat(F.lit(" "), F.upper("unit"), F.lit(" "))).when(F.col("kind") == 3, "EUR").otherwise(F.col("unit"))
    same_unit = F.lower(F.trim(said)) == F.lower(F.trim("unit"))
    return _pairs(spark, sf_dir).select("claim_id", (N.close(F.col("claimed"), F.col("value"), 0.01) & same_unit).alias("correct"))


@query(_C + " SELECT claim_id, abs(claimed - value) <= 1e-6::DOUBLE * greatest(abs(claimed), abs(value)) AS tight, isfinite(claimed) AS finite FROM pairs")
def tight_match(spark, sf_dir):
    """N04, N13."""
    return _pairs(spark, sf_dir).select("claim_id", N.close(F.col("claimed"), F.col("value"), 1e-6).alias("tight"), N.finite(F.col("claimed")).alias("finite"))


@query(_C + " SELECT claim_id, value <> floor(value) AND round_even(value, 0) = claimed AS rounded FROM pairs")
def rounded_fact(spark, sf_dir):
    """N05."""
    return _pairs(spark, sf_dir).select("claim_id", N.rounded_of(F.col("claimed"), F.col("value")).alias("rounded"))


@query(f"""WITH {V.FACTS} SELECT a.ticker, a.concept, a.fiscal_year, b.fiscal_year AS other_year, b.concept AS other_concept, round(a.value - b.value, 4) AS difference,
CASE WHEN a.concept = b.concept AND b.value <> 0 THEN round((a.value - b.value) / b.value * 100, 6) END AS change, CASE WHEN a.fiscal_year = b.fiscal_year AND b.value <> 0 THEN round(a.value / b.value * 100, 4) END AS ratio
FROM facts a JOIN facts b ON a.ticker = b.ticker AND ((a.concept = b.concept AND a.fiscal_year <> b.fiscal_year) OR (a.concept <> b.concept AND a.fiscal_year = b.fiscal_year))""")
def derived_values(spark, sf_dir):
    """Differences, changes and ratios of a company's facts."""
    a = V.facts(spark, sf_dir).select("ticker", "fiscal_year", "concept", "value")
    b = a.select("ticker", F.col("fiscal_year").alias("other_year"), F.col("concept").alias("other_concept"), F.col("value").alias("other"))
    same, year = F.col("concept") == F.col("other_concept"), F.col("fiscal_year") == F.col("other_year")
    j = a.join(b, "ticker").where(same != year)
    return j.select(
        "ticker", "concept", "fiscal_year", "other_year", "other_concept", F.round(F.col("value") - F.col("other"), 4).alias("difference"),
        F.when(same, F.round(F.try_divide(F.col("value") - F.col("other"), F.col("other")) * 100, 6)).alias("change"), F.when(year, F.round(F.try_divide(F.col("value"), F.col("other")) * 100, 4)).alias("ratio"))


@query(f"""WITH {V.FACTS}, e AS (SELECT ticker, concept, min_by(value, fiscal_year) AS first, max_by(value, fiscal_year) AS last FROM facts GROUP BY ALL) SELECT ticker, concept, last AS headline, round(last - first, 4) AS change, round((last - first) / nullif(abs(first), 0) * 100, 6) AS percent FROM e""")
def comparative_normalize(spark, sf_dir):
    """The final value as headline, its change and percent of the first."""
    e = V.facts(spark, sf_dir).groupBy("ticker", "concept").agg(F.min_by("value", "fiscal_year").alias("first"), F.max_by("value", "fiscal_year").alias("last"))
    return e.select("ticker", "concept", F.col("last").alias("headline"), F.round(F.col("last") - F.col("first"), 4).alias("change"), F.round(N.percent_change(F.col("first"), F.col("last")), 6).alias("percent"))


@query(f"""WITH {V.FACTS}, e AS (SELECT ticker, concept, min(fiscal_year) AS y0, max(fiscal_year) AS y1, min_by(value, fiscal_year) AS v0, max_by(value, fiscal_year) AS v1 FROM facts GROUP BY ALL),
a AS (SELECT ticker, concept, CASE WHEN concept <> 'Lines' THEN 'USD' END AS unidad, CASE WHEN concept = 'Quantity' AND length(ticker) > 9 THEN 'xbrl' ELSE 'ambas' END AS fuente, CASE WHEN length(ticker) % 2 = 0 THEN y1 ELSE y0 END AS yi, CASE WHEN length(ticker) % 2 = 0 THEN y0 ELSE y1 END AS yf,
 CASE WHEN length(ticker) % 2 = 0 THEN v1 ELSE v0 END AS vi, CASE WHEN ticker = 'MACHINERY' AND concept = 'Revenue' THEN NULL WHEN length(ticker) % 2 = 0 THEN v0 ELSE v1 END AS vf FROM e),
v AS (SELECT *, concat_ws(', ', CASE WHEN ticker IS NULL THEN 'ticker' END, CASE WHEN unidad IS NULL THEN 'unidad' END, CASE WHEN yi IS NULL THEN 'ejercicio_inicial' END, CASE WHEN vi IS NULL THEN 'cifra_inicial' END, CASE WHEN yf IS NULL THEN 'ejercicio_final' END, CASE WHEN vf IS NULL THEN 'cifra_final' END) AS gone FROM a)
SELECT ticker, concept, CASE WHEN gone <> '' THEN 'missing ' || gone WHEN fuente <> 'ambas' THEN 'source' WHEN yf <= yi THEN 'years' ELSE 'ok' END AS verdict,
CASE WHEN gone = '' AND fuente = 'ambas' AND yf > yi THEN round(vf - vi, 4) END AS change, CASE WHEN gone = '' AND fuente = 'ambas' AND yf > yi AND vi <> 0 THEN round((vf - vi) / abs(vi) * 100, 6) END AS percent FROM v""")
def comparative_contract(spark, sf_dir):
    """A comparative answer's missing fields, source and order of years; its change and percent if all is well."""
    e = V.facts(spark, sf_dir).groupBy("ticker", "concept").agg(F.min("fiscal_year").alias("y0"), F.max("fiscal_year").alias("y1"), F.min_by("value", "fiscal_year").alias("v0"), F.max_by("value", "fiscal_year").alias("v1"))
    turned = F.length("ticker") % 2 == 0
    a = e.select(
        "ticker", "concept", F.when(F.col("concept") != "Lines", "USD").alias("unidad"), F.when((F.col("concept") == "Quantity") & (F.length("ticker") > 9), "xbrl").otherwise("ambas").alias("fuente"),
        F.when(turned, F.col("y1")).otherwise(F.col("y0")).alias("ejercicio_inicial"), F.when(turned, F.col("y0")).otherwise(F.col("y1")).alias("ejercicio_final"), F.when(turned, F.col("v1")).otherwise(F.col("v0")).alias("cifra_inicial"),
        F.when((F.col("ticker") == "MACHINERY") & (F.col("concept") == "Revenue"), None).when(turned, F.col("v0")).otherwise(F.col("v1")).alias("cifra_final"))
    a = a.withColumn("verdict", golden.comparative_verdict())
    change = F.when(F.col("verdict") == "ok", F.col("cifra_final") - F.col("cifra_inicial"))
    return a.select("ticker", "concept", "verdict", F.round(change, 4).alias("change"), F.round(F.try_divide(change, F.abs("cifra_inicial")) * 100, 6).alias("percent"))


@query("SELECT conv_id, first(text ORDER BY turn) FILTER (role = 'user') AS first_user, last(text ORDER BY turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY 1")
def first_last_message(spark, sf_dir):
    """A thread's question and its last answer."""
    m = _messages(spark, sf_dir).groupBy("conv_id")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return m.agg(F.min_by("text", F.when(user, F.col("turn"))).alias("first_user"), F.max_by("text", F.when(assistant, F.col("turn"))).alias("last_assistant"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, line, len(regexp_extract_all(lower(line), '[a-z0-9$%.]+')) AS score FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY score DESC) AS r FROM s) SELECT doc_id, CASE WHEN count(*) = 1 THEN max(line) END AS line FROM r WHERE r = 1 GROUP BY 1""")
def unique_best_line(spark, sf_dir):
    """The line with most tokens, if no other has as many."""
    lines = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("score", F.size(T.tokens(F.col("line"))))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"))
    best = lines.withColumn("r", F.rank().over(w)).where("r = 1").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("line").alias("line"))
    return best.select("doc_id", F.when(F.col("n") == 1, F.col("line")).alias("line"))


@query("SELECT event_id, CASE event_id % 3 WHEN 1 THEN floor(epoch(ts))::BIGINT WHEN 2 THEN floor(epoch(ts))::BIGINT - 7200 END AS seconds FROM events")
def zoned_times(spark, sf_dir):
    """Times of day with an offset, or none, in seconds of the epoch; those without are refused."""
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 1, "Z").when(F.col("event_id") % 3 == 2, "+02:00").otherwise(""))
    return V.table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(T.zoned_time(said)).alias("seconds"))


# Numbers in prose, with either separator and words of size.
_PROSE = "text || ' Ingresos de ' || item_id || ',' || (item_id % 10) || ' millones en FY2024 y 1.234,5 miles; also 2.5 Billion, 1,000.25, 0,125 or 10 200, -3, 12mn, 1.2.3 and ' || item_id || '.' || item_id || '.'"
_CLEAN = "regexp_replace(list_extract(raws, i), '[.,]+$', '')"


@query(f"""WITH s AS (SELECT item_id AS query_id, {_PROSE} AS said FROM benchmark), m AS (SELECT query_id, regexp_extract_all(said, '(?i)([0-9][0-9.,]*)\\s*(billion|billones|mil millones|million|millones|millón|thousand|miles)?', 1) AS raws, regexp_extract_all(said, '(?i)([0-9][0-9.,]*)\\s*(billion|billones|mil millones|million|millones|millón|thousand|miles)?', 2) AS sizes FROM s),
e AS (SELECT query_id, i, lower(list_extract(sizes, i)) AS size, {_CLEAN} AS n FROM (SELECT *, unnest(range(1, len(raws) + 1)) AS i FROM m)),
v AS (SELECT query_id, i, size, TRY_CAST(CASE WHEN contains(n, ',') AND contains(n, '.') THEN CASE WHEN instr(reverse(n), ',') < instr(reverse(n), '.') THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END
 WHEN contains(n, ',') THEN CASE WHEN instr(reverse(n), ',') <> 4 THEN replace(left(n, length(n) - instr(reverse(n), ',')), ',', '') || '.' || right(n, instr(reverse(n), ',') - 1) ELSE replace(n, ',', '') END WHEN contains(n, '.') AND instr(reverse(n), '.') = 4 THEN replace(n, '.', '') ELSE n END AS DOUBLE) AS value FROM e)
SELECT query_id, i - 1 AS place, value * CASE WHEN size IN ('billion', 'billones', 'mil millones') THEN 1e9 WHEN size IN ('million', 'millones', 'millón') THEN 1e6 WHEN size IN ('thousand', 'miles') THEN 1e3 ELSE 1 END AS number FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS k FROM v WHERE value IS NOT NULL)""".replace("SELECT query_id, i - 1 AS place", "SELECT query_id, k - 1 AS place"))
def number_extract(spark, sf_dir):
    """Numbers in prose with separators and words of size."""
    q = F.col("query_id").cast("string")
    said = F.concat("text", F.lit(" Ingresos de "), q, F.lit(","), (F.col("query_id") % 10).cast("string"), F.lit(" millones en FY2024 y 1.234,5 miles; also 2.5 Billion, 1,000.25, 0,125 or 10 200, -3, 12mn, 1.2.3 and "), q, F.lit("."), q, F.lit("."))
    return V.questions(spark, sf_dir).select("query_id", F.posexplode(N.prose_numbers(said)).alias("place", "number")).withColumn("place", F.col("place").cast("long"))
