"""The test tables as the evidence model: sections, chunks, vectors, questions, facts, claims, traces, messages.

Each view is a function of (spark, sf_dir) and, in capitals, its SQL as a body of a WITH clause.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.operators import lexical
from quaestor.sources.tables import shared_folder

CHUNK, STEP = 400, 320


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """All documents, or those `of` a table, as sections."""
    d = table(spark, sf_dir, "documents") if of is None else of
    item = F.element_at(F.array(*(F.lit(x) for x in ("1A", "7", "7A", "8"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", F.upper("source").alias("ticker"), (F.col("doc_id") % 2 + 2024).alias("fiscal_year"), item.alias("item"), F.col("text").alias("texto"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


SECTIONS = """sections AS (SELECT doc_id, upper(source) AS ticker, 2024 + doc_id % 2 AS fiscal_year, (['1A','7','7A','8'])[doc_id % 4 + 1] AS item,
 text AS texto, len(regexp_extract_all(lower(text), '[a-z0-9$%.]+'))::BIGINT AS n_tokens FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Windows of CHUNK characters, every STEP of them, of each section; a document is a ticker of its own."""
    s = sections(spark, sf_dir, of).withColumn("ticker", F.concat_ws(".", "ticker", "doc_id")).withColumn("length", F.length("texto"))
    pieces = F.regexp_extract_all("texto", F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))  # one pass; substring counts from a text's start for each window
    s = s.where("length > 0").withColumn("_pieces", pieces).withColumn("posicion", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("length") - 1 - (CHUNK - STEP), F.lit(0)) / STEP).cast("int"))))
    start = F.col("posicion") * STEP
    after = F.coalesce(F.substring(F.get("_pieces", F.col("posicion") + 1), 1, CHUNK - STEP), F.lit(""))
    s = s.withColumn("texto", F.concat(F.get("_pieces", F.col("posicion")), after)).withColumn("inicio_car", start.cast("long"))
    s = s.withColumn("fin_car", F.col("inicio_car") + F.length("texto")).withColumn("posicion", F.col("posicion").cast("long"))
    s = s.withColumn("contiene_tabla", F.contains("texto", F.lit("|"))).withColumn("n_tokens", F.size(T.tokens(F.col("texto"))).cast("long"))
    s = s.withColumn("chunk_id", T.chunk_id(F.col("ticker"), F.col("fiscal_year"), F.col("item"), F.col("posicion")))
    return s.select("chunk_id", "doc_id", "ticker", "fiscal_year", "item", "posicion", "texto", "n_tokens", "contiene_tabla", "inicio_car", "fin_car")


CHUNKS = f"""{SECTIONS}, cut AS (SELECT *, unnest(range(0, floor(greatest(length(texto) - 1 - {CHUNK - STEP}, 0) / {STEP})::BIGINT + 1)) AS posicion FROM sections WHERE length(texto) > 0),
chunks AS (SELECT printf('%s.%d-%d-%s-%04d', ticker, doc_id, fiscal_year, item, posicion) AS chunk_id, doc_id, ticker || '.' || doc_id AS ticker, fiscal_year, item, posicion,
 substring(texto, posicion * {STEP} + 1, {CHUNK}) AS texto, len(regexp_extract_all(lower(substring(texto, posicion * {STEP} + 1, {CHUNK})), '[a-z0-9$%.]+'))::BIGINT AS n_tokens,
 contains(substring(texto, posicion * {STEP} + 1, {CHUNK}), '|') AS contiene_tabla, posicion * {STEP} AS inicio_car, posicion * {STEP} + length(substring(texto, posicion * {STEP} + 1, {CHUNK})) AS fin_car FROM cut)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


VECTORS = "vectors AS (SELECT vec_id AS id, embedding AS vector, label::BIGINT AS label FROM embeddings)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts, each with the vector of its number."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select(F.col("id").alias("query_id"), "vector")
    return questions(spark, sf_dir).select("query_id").join(v, "query_id")


#: All scores of questions with vectors, to 6 decimals.
DENSE = f"""{VECTORS}, dense AS (SELECT q.item_id AS query_id, v.id, v.label, round(list_inner_product(qv.vector::DOUBLE[], v.vector::DOUBLE[]), 6) AS score
 FROM benchmark q JOIN vectors qv ON qv.id = q.item_id CROSS JOIN vectors v)"""


def bm25_sql(corpus: str, key: str, text: str) -> str:
    """BM25 of questions with the rows of a corpus, for those with a common token."""
    return rf"""toks AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9$%.]+')) AS term FROM {corpus}),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY 1),
size AS (SELECT (SELECT count(*) FROM {corpus}) AS n, (SELECT avg(len(regexp_extract_all(lower({text}), '[a-z0-9$%.]+'))) FROM {corpus}) AS avgdl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT round(0.25 * avg(raw), 9) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9$%.]+')) AS term FROM benchmark) GROUP BY ALL),
bm25 AS (SELECT query_id, tf.id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
 FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, size GROUP BY ALL)"""


BM25 = bm25_sql("documents", "doc_id", "text")


#: The questions of the queries share most of their words' buckets, so that few do.
INDEX_BUCKETS = 8
_INDEXES: dict[tuple, lexical.Index] = {}


def index(spark: SparkSession, sf_dir: str, corpus: str) -> lexical.Index:
    """The stored index of all `documents` or `chunks`, built when it is first asked for and again if the files change."""
    files = table(spark, sf_dir, "documents").agg(F.count("*"), F.max("_metadata.file_modification_time"), F.sum(F.xxhash64("_metadata.file_path", "_metadata.file_size").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, corpus, sf_dir, *files)
    if key not in _INDEXES:
        rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text") if corpus == "documents" else chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), F.col("texto").alias("text"))
        _INDEXES[key] = lexical.build(rows, f"{shared_folder(spark)}/indexes/{corpus}-{uuid.uuid4().hex}", INDEX_BUCKETS)
    return _INDEXES[key]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported values by market segment and year, summed in whole cents so that any order gives the same."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    lines = o.join(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    by = lines.groupBy(F.col("c_mktsegment").alias("ticker"), F.year("o_orderdate").cast("long").alias("fiscal_year")).agg(
        F.sum(cents).alias("revenue"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("lines"))
    wide = by.select("ticker", "fiscal_year", F.expr("stack(3, 'Revenue', revenue / 100.0D, 'USD', 'Quantity', CAST(quantity AS DOUBLE), 'pieces', 'Lines', CAST(lines AS DOUBLE), 'rows') AS (concept, value, unit)"))
    return wide.withColumn("period_end", F.format_string("%d-12-31", "fiscal_year")).withColumn("form", F.lit("10-K"))


FACTS = """reported AS (SELECT c_mktsegment AS ticker, year(o_orderdate) AS fiscal_year, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100 AS revenue, sum(l_quantity::BIGINT)::DOUBLE AS quantity, count(*)::DOUBLE AS n
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
facts AS (SELECT ticker, fiscal_year, concept, value, unit, fiscal_year || '-12-31' AS period_end, '10-K' AS form FROM
 (SELECT ticker, fiscal_year, 'Revenue' AS concept, revenue AS value, 'USD' AS unit FROM reported UNION ALL SELECT ticker, fiscal_year, 'Quantity', quantity, 'pieces' FROM reported UNION ALL SELECT ticker, fiscal_year, 'Lines', n, 'rows' FROM reported))"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each fact, right, rounded, off by half or by five percent, or of another fact's size."""
    f = facts(spark, sf_dir)
    kind = F.pmod(F.length("ticker") + F.col("fiscal_year") + F.length("concept"), F.lit(5))
    value = F.when(kind == 0, F.col("value")).when(kind == 1, F.col("value") * 1.005).when(kind == 2, F.col("value") * 1.05).when(kind == 3, F.bround("value")).otherwise(F.col("value") / 2)
    return f.select(F.concat_ws("/", "ticker", "fiscal_year", "concept").alias("claim_id"), "ticker", "fiscal_year", "concept", value.alias("claimed"), "unit", kind.cast("long").alias("kind"))


CLAIMS = f"""{FACTS}, kinds AS (SELECT *, (length(ticker) + fiscal_year + length(concept)) % 5 AS kind FROM facts),
claims AS (SELECT concat_ws('/', ticker, fiscal_year, concept) AS claim_id, ticker, fiscal_year, concept, unit, kind,
 CASE kind WHEN 0 THEN value WHEN 1 THEN value * 1.005::DOUBLE WHEN 2 THEN value * 1.05::DOUBLE WHEN 3 THEN round_even(value, 0) ELSE value / 2 END AS claimed FROM kinds)"""

#: What each event type of the log stands for as a tool of a trace.
TOOLS = {"click": "buscar_secciones", "view": "leer_seccion", "purchase": "consultar_dato", "signup": "listar_catalogo", "error": "error"}


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: user as question, type as tool, value as latency, k of props as argument."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("question_id"), F.col("event_type").alias("tool"), F.col("ts"), F.col("value").alias("latency"), "props", F.from_json("props", "k long")["k"].alias("k"))


TRACE = "trace AS (SELECT event_id AS call_id, user_id AS question_id, event_type AS tool, ts, value AS latency, props, (props::JSON ->> 'k')::BIGINT AS k FROM events)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored answers: family by id, criteria from labels where there are any, recall and cost with gaps."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    family = F.element_at(F.array(*(F.lit(x) for x in ("extractiva", "numerica", "comparativa"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return j.select(
        F.col("doc_id").alias("id"), F.upper("source").alias("ticker"), family.alias("familia"),
        F.when(F.col("doc_id") % 3 != 1, F.col("quality") == 1).alias("cita"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic") == 0).alias("cifra"),
        (F.col("n_chars") % 4 != 0).alias("trayectoria"), F.when(F.col("doc_id") % 3 != 1, F.col("quality").cast("double")).alias("recall"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") / 1e6).alias("coste"), (F.col("n_chars") % 5000).alias("latencia_ms"), (F.col("doc_id") % 5).alias("llamadas"))


RESULTS = """results AS (SELECT d.doc_id AS id, upper(source) AS ticker, (['extractiva','numerica','comparativa'])[d.doc_id % 3 + 1] AS familia,
 CASE WHEN d.doc_id % 3 <> 1 THEN quality = 1 END AS cita, CASE WHEN d.doc_id % 3 <> 0 THEN toxic = 0 END AS cifra, n_chars % 4 <> 0 AS trayectoria,
 CASE WHEN d.doc_id % 3 <> 1 THEN quality::DOUBLE END AS recall, CASE WHEN d.doc_id % 7 <> 0 THEN n_chars / 1e6::DOUBLE END AS coste, n_chars % 5000 AS latencia_ms, d.doc_id % 5 AS llamadas
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
