"""Search over the whole corpus: each question's hits are the best of all chunks by BM25. The study of retrievers has no SQL; tests hold all of it against plain Python."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.operators import containment, dense, fusion
from quaestor.sources.tables import stored

from . import views as V
from .registry import query

#: What a search returns for each question.
K = 20
#: Dense candidates of each question for fusion.
CANDIDATES = 50


_SCORED = f"WITH {V.CHUNKS}, {V.bm25_sql('chunks', 'chunk_id', 'texto')}"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"
_HITS = f"""{_SCORED}, best AS (SELECT query_id, id, score, {_RANK} FROM bm25 QUALIFY rank <= {K}), hits AS (SELECT b.query_id, b.score, b.rank, c.*, regexp_replace(c.chunk_id, '-[^-]*$', '-0000') AS parent FROM best b JOIN chunks c ON c.chunk_id = b.id)"""
#: A score, which has 6 decimals, to 4 or 3, half up as Spark rounds.
_SCORE4 = "floor(score * 10000 + 0.50001) / 10000"
_SCORE3 = "floor(score * 1000 + 0.50001) / 1000"


def hits(spark, sf_dir, k=K, **wanted):
    """The k best chunks of each question, with their columns, score and rank; weights are those of all chunks, filters come before k."""
    q = V.questions(spark, sf_dir)
    allowed = V.chunks(spark, sf_dir).where(dense.metadata_filter(**wanted)).select(F.col("chunk_id").alias("id")) if wanted else None
    best = V.index(spark, sf_dir, "chunks").best(q, k, allowed).withColumn("rank", F.col("rank").cast("long")).withColumnRenamed("id", "chunk_id")
    best = stored(best, "best")  # k rows for each question: a small table, so that no documents are shuffled to meet it
    return stored(best.join(chunks_of(spark, sf_dir, best), "chunk_id"), "hits")


def chunks_of(spark, sf_dir, ids):
    """The chunks of the documents that some chunk ids (a stored table's chunk_id) name, whose number stands in the id; no other documents are cut."""
    named = ids.select(F.regexp_extract("chunk_id", r"\.(\d+)-\d+-[^-]+-\d+$", 1).try_cast("long").alias("doc_id")).distinct()
    return V.chunks(spark, sf_dir, V.table(spark, sf_dir, "documents").join(named, "doc_id", "left_semi"))


@query(_HITS + """, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY rank, chunk_id) AS n FROM hits), k AS (SELECT query_id, parent, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS parent_rank FROM one WHERE n = 1) SELECT * FROM k WHERE parent_rank <= 3""")
def parent_expand(spark, sf_dir):
    """The best chunk of each section, three sections, of the chunks found."""
    h = hits(spark, sf_dir).select("query_id", F.col("chunk_id").alias("id"), T.parent_id(F.col("chunk_id")).alias("parent"), "rank")
    out = fusion.best_of_parent(h, 3)
    return out.select("query_id", "parent", F.col("id").alias("chunk_id"), "rank", F.col("parent_rank").cast("long").alias("parent_rank"))


@query(_HITS + " SELECT query_id, parent, min(rank) AS rank, count(*) AS n FROM hits GROUP BY ALL")
def best_parent(spark, sf_dir):
    """Each section's best rank among twenty hits."""
    return hits(spark, sf_dir).groupBy("query_id", T.parent_id(F.col("chunk_id")).alias("parent")).agg(F.min("rank").alias("rank"), F.count("*").alias("n"))


# Both templates of a hit's first line, and the older one's text for no hits.
_HEAD = "[%s] %s FY%d Item %s (puntuación %.4f)"
_OLD_HEAD = "[%s] %s FY%d Item %s (similitud %.3f)"
_OLD_EMPTY = "Sin resultados para esa consulta con esos filtros. Prueba a quitar algún filtro o a reformular la búsqueda."


def _texts_sql(head, score):
    return rf""", lines AS (SELECT query_id, rank, printf('{head}', chunk_id, ticker, fiscal_year, item, {score}) || chr(10) || texto AS line FROM hits WHERE rank <= 3),
texts AS (SELECT query_id, string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS rendered FROM lines GROUP BY 1)"""


_RENDER = _HITS + _texts_sql(_HEAD, _SCORE4)


def _rendered(spark, sf_dir, head=_HEAD):
    line = F.concat(F.format_string(head, "chunk_id", "ticker", "fiscal_year", "item", "score"), F.lit("\n"), "texto")
    h = hits(spark, sf_dir, 3).select("query_id", F.struct("rank", line.alias("line")).alias("l"))
    return h.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("l"))["line"], "\n\n---\n\n").alias("rendered"))


@query(_RENDER + " SELECT query_id, rendered FROM texts")
def render_hits(spark, sf_dir):
    """The text that a search tool returns."""
    return _rendered(spark, sf_dir)


@query(_HITS + _texts_sql(_OLD_HEAD, _SCORE3) + f" SELECT item_id AS query_id, coalesce(rendered, '{_OLD_EMPTY}') AS rendered FROM benchmark LEFT JOIN texts ON query_id = item_id")
def render_hits_legacy(spark, sf_dir):
    """The older form of that text; a question without hits gets advice."""
    texts = _rendered(spark, sf_dir, _OLD_HEAD)
    return V.questions(spark, sf_dir).select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("rendered", F.lit(_OLD_EMPTY)).alias("rendered"))


@query(_RENDER + r""" SELECT query_id, array_to_string(regexp_extract_all(rendered, '(?m)^\[([A-Z0-9.-]+-\d{4}-[A-Z0-9.-]+-\d{4,})\]\s', 1), ',') AS ids FROM texts""")
def parse_hit_ids(spark, sf_dir):
    """The ids back from a rendered text, in order."""
    return _rendered(spark, sf_dir).select("query_id", F.array_join(T.hit_ids(F.col("rendered")), ",").alias("ids"))


@query(_HITS + f" SELECT query_id, chunk_id, ticker, fiscal_year, item, posicion, {_SCORE4} AS puntuacion FROM hits WHERE rank <= 5")
def hit_projection(spark, sf_dir):
    """What a hit shows."""
    return hits(spark, sf_dir, 5).select("query_id", "chunk_id", "ticker", "fiscal_year", "item", "posicion", F.round("score", 4).alias("puntuacion"))


@query(_SCORED + f", best AS (SELECT query_id, id, fiscal_year, {_RANK} FROM bm25 JOIN chunks ON chunk_id = id WHERE fiscal_year = 2024 QUALIFY rank <= {K}) SELECT query_id, count(*) <= {K} AS within_k, count(DISTINCT id) = count(*) AS unique_ids, bool_and(fiscal_year = 2024) AS filter_respected FROM best GROUP BY 1")
def search_contract(spark, sf_dir):
    """At most k rows, unique ids, the filter respected, of a search in one year."""
    h = hits(spark, sf_dir, fiscal_year=2024)
    return h.groupBy("query_id").agg((F.count("*") <= K).alias("within_k"), (F.count_distinct("chunk_id") == F.count("*")).alias("unique_ids"), F.bool_and(F.col("fiscal_year") == 2024).alias("filter_respected"))


# Measures of a search: a question's whole text is its anchor, found if a hit holds it.


def owners(spark, sf_dir):
    """(query_id, doc_id, start, stop): documents that hold a question's text in normal form; where it stands, if they hold it exactly."""
    return owners_of(spark, sf_dir, V.questions(spark, sf_dir))


def owners_of(spark, sf_dir, questions):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    pairs = stored(containment.containing(questions.where(T.lowered(F.col("text")) != ""), d, T.lowered), "pairs")
    at = F.expr("instr(body, text)").cast("long")
    return pairs.join(d, "doc_id").join(questions.select("query_id", "text"), "query_id").select("query_id", "doc_id", F.when(at > 0, at - 1).alias("start"), F.when(at > 0, at - 1 + F.length("text")).alias("stop"))


def found(spark, sf_dir):
    """For each hit: whether it holds the whole anchor, exactly or in normal form, and whether it is of the anchor's own document too.

    A hit of the anchor's own document counts if it covers the anchor's span or holds it in normal form.
    """
    h = hits(spark, sf_dir).join(V.questions(spark, sf_dir), "query_id").join(owners(spark, sf_dir).withColumn("owned", F.lit(True)), ["query_id", "doc_id"], "left")
    exact, form = F.contains("texto", F.col("text")), F.contains(T.lowered(F.col("texto")), T.lowered(F.col("text")))
    covered = F.coalesce((F.col("inicio_car") <= F.col("start")) & (F.col("fin_car") >= F.col("stop")), F.lit(False))
    return h.select("query_id", "rank", exact.alias("hit"), form.alias("loose"), F.coalesce(F.col("owned") & (covered | form), F.lit(False)).alias("own"))


def _form(column: str) -> str:
    return f"lower(trim(regexp_replace({column}, '\\s+', ' ', 'g')))"


_FOUND = _HITS + f""", anchors AS (SELECT item_id AS query_id, text AS anchor, {_form('text')} AS form FROM benchmark),
owners AS (SELECT query_id, doc_id, instr(d.text, anchor) AS place, length(anchor) AS n FROM anchors JOIN documents d ON form <> '' AND contains({_form('d.text')}, form)),
found AS (SELECT h.query_id, h.rank, contains(texto, anchor) AS hit, contains({_form('texto')}, form) AS loose, coalesce(o.doc_id IS NOT NULL AND (coalesce(place > 0 AND inicio_car <= place - 1 AND fin_car >= place - 1 + n, false) OR contains({_form('texto')}, form)), false) AS own
FROM hits h JOIN anchors a ON a.query_id = h.query_id LEFT JOIN owners o ON o.query_id = h.query_id AND o.doc_id = h.doc_id)"""


@query(_FOUND + " SELECT query_id, bool_or(hit AND rank <= 5) AS hit FROM found GROUP BY 1")
def anchor_recall_trace(spark, sf_dir):
    """The exact, whole anchor among the first five hits, whatever the document."""
    return found(spark, sf_dir).groupBy("query_id").agg(F.bool_or(F.col("hit") & (F.col("rank") <= 5)).alias("hit"))


@query(_FOUND + " SELECT query_id, bool_or(own AND rank <= 5) AS hit FROM found GROUP BY 1")
def anchor_recall_isolated(spark, sf_dir):
    """The same ticker and year; the anchor's span covered or its text held in normal form among the first five hits."""
    return found(spark, sf_dir).groupBy("query_id").agg(F.bool_or(F.col("own") & (F.col("rank") <= 5)).alias("hit"))


@query(_FOUND + " SELECT query_id, min(rank) FILTER (loose) AS first_rank FROM found GROUP BY 1")
def anchor_rank(spark, sf_dir):
    """The rank of the first of the hits that holds the anchor in normal form, null if none does."""
    return found(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("loose"), F.col("rank"))).alias("first_rank"))


@query(_FOUND + ", h AS (SELECT query_id, bool_or(loose AND rank <= 5) AS hit FROM found GROUP BY 1) SELECT round(coalesce(avg(coalesce(hit, false)::INT), 0), 6) AS recall FROM benchmark LEFT JOIN h ON query_id = item_id")
def recall_at_k(spark, sf_dir):
    """The share of all questions with the anchor in normal form among five hits, 0 without questions."""
    hit = found(spark, sf_dir).groupBy("query_id").agg(F.bool_or(F.col("loose") & (F.col("rank") <= 5)).alias("hit"))
    both = V.questions(spark, sf_dir).select("query_id").join(hit, "query_id", "left")
    return both.agg(F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(False)).cast("int")), F.lit(0.0)), 6).alias("recall"))


@query(_FOUND + " SELECT query_id, min(rank) FILTER (hit) AS exact, min(rank) FILTER (loose) AS loose FROM found GROUP BY 1")
def anchor_rank_pivot(spark, sf_dir):
    """The first rank by exact and by normal form."""
    return found(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("exact"), F.min(F.when(F.col("loose"), F.col("rank"))).alias("loose"))


# The ablation: six retrievers over all documents.

CONFIGS = ("bm25", "flat", "filtered", "fused", "rewrite", "rewrite_fused")


def configurations(spark, sf_dir, k=K, asked=None):
    """(config, query_id, id, rank): the k best documents of each question by each retriever; `asked` are other words for some questions.

    filtered keeps to vectors of the label of the question's own. A rewrite is the recorded one or the question itself; there is
    no encoder for it here, so it is ranked by BM25, and rewrite_fused fuses that with the question's vector.
    """
    v, q = V.vectors(spark, sf_dir), V.question_vectors(spark, sf_dir)
    corpus = V.index(spark, sf_dir, "documents")
    c = V.table(spark, sf_dir, "conversations").where("turn = 0 AND role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("text").alias("rewrite"))
    asked = V.questions(spark, sf_dir) if asked is None else asked
    said = asked.join(c, "query_id", "left").select("query_id", F.coalesce("rewrite", "text").alias("text"))
    near = stored(dense.search(v, q, CANDIDATES).drop("rank"), "near")
    fused = lambda texts: fusion.fuse_ranks(near, corpus.ranks(texts, near, "lexical_rank"), k)
    labelled = q.join(v.select(F.col("id").alias("query_id"), "label"), "query_id")
    filtered = dense.search(v, labelled, k, on="label")
    lists = {"bm25": corpus.best(asked, k), "flat": dense.top_k(near, k), "fused": fused(asked), "rewrite": corpus.best(said, k), "rewrite_fused": fused(said), "filtered": filtered}
    out = None
    for name, found_ in lists.items():
        part = found_.select(F.lit(name).alias("config"), "query_id", "id", F.col("rank").cast("long").alias("rank"))
        out = part if out is None else out.unionAll(part)
    return out


def grid(spark, sf_dir, asked=None):
    """(config, k, strict, query_id, hit, first_rank): each question under each setting, also if nothing was found; anchors are the whole questions."""
    held = owners(spark, sf_dir).select("query_id", F.col("doc_id").alias("id"), F.col("start").isNotNull().alias("exact"))
    ranks = configurations(spark, sf_dir, asked=asked).join(held, ["query_id", "id"]).groupBy("config", "query_id").agg(F.min(F.when(F.col("exact"), F.col("rank"))).alias("exact"), F.min("rank").alias("loose"))
    every = V.questions(spark, sf_dir).select("query_id").withColumn("config", F.explode(F.array(*map(F.lit, CONFIGS))))
    every = every.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 5, 20))))).withColumn("strict", F.explode(F.array(F.lit(True), F.lit(False))))
    first = F.when(F.col("strict"), F.col("exact")).otherwise(F.col("loose"))
    g = every.join(ranks, ["config", "query_id"], "left").withColumn("first_rank", first)
    return g.select("config", "k", "strict", "query_id", F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False)).alias("hit"), "first_rank")


@query()
def recall_study(spark, sf_dir):
    """Recall of six retrievers by k and strictness, and what was missed."""
    missed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("hit"), F.col("query_id")))).cast("array<string>"), ", ")
    return grid(spark, sf_dir).groupBy("config", "k", "strict").agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 3).alias("recall"), missed.alias("missed"))


@query()
def recall_pooled_best(spark, sf_dir):
    """The best of all settings, ties by an explicit order."""
    p = grid(spark, sf_dir).groupBy("config", "k", "strict").agg(F.round(F.sum(F.col("hit").cast("int")) / F.count("*"), 6).alias("pooled"))
    return p.orderBy(F.desc("pooled"), "k", "strict", "config").limit(1)


#: Words of a question that the second data set asks by.
SHORT = 8


def datasets(spark, sf_dir):
    """grid() of two data sets: `whole` asks by a question's text, `short` by its first words; both look for the whole text."""
    q = V.questions(spark, sf_dir)
    short = q.select("query_id", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, SHORT), " ").alias("text"))
    return grid(spark, sf_dir).withColumn("dataset", F.lit("whole")).unionByName(grid(spark, sf_dir, short).withColumn("dataset", F.lit("short")))


@query()
def study_by_dataset(spark, sf_dir):
    """Recall of six retrievers on two data sets."""
    return datasets(spark, sf_dir).groupBy("dataset", "config", "k", "strict").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("recall"))


@query()
def study_pooled(spark, sf_dir):
    """Hits and cases of each setting summed over the data sets, the best first in a fixed order; `best` marks the first."""
    p = study_by_dataset(spark, sf_dir).groupBy("config", "k", "strict").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).withColumn("recall", F.round(F.col("hits") / F.col("n"), 6))
    place = F.row_number().over(Window.orderBy(F.desc("recall"), "k", "strict", "config"))  # 36 settings
    return p.withColumn("best", place == 1)
