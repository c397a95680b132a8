"""Search and its measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.functions import numeric as N
from quaestor.functions import text as T
from quaestor.operators import containment, dense, fusion, lexical
from quaestor.sources.tables import stored

from . import views as V
from .registry import query

K = 5
#: Dense candidates of each question for fusion.
CANDIDATES = 50


def _dense(spark, sf_dir, k=CANDIDATES):
    """Candidates of each question, a bounded number, stored as more than one step reads them."""
    return stored(dense.search(V.vectors(spark, sf_dir), V.question_vectors(spark, sf_dir), k).drop("rank"), "near")


def _bm25(spark, sf_dir, allowed=None):
    return V.index(spark, sf_dir, "documents").search(V.questions(spark, sf_dir), allowed)


def _best(spark, sf_dir, k):
    return V.index(spark, sf_dir, "documents").best(V.questions(spark, sf_dir), k)


def _ranks(spark, sf_dir, near):
    return V.index(spark, sf_dir, "documents").ranks(V.questions(spark, sf_dir), near, "lexical_rank")


@query(f"""WITH {V.BM25} SELECT query_id, id, score FROM bm25""")
def bm25_scores(spark, sf_dir):
    """Scores of all documents that share a token; the others are zero."""
    return _bm25(spark, sf_dir)


@query(f"""WITH {V.BM25} SELECT item_id AS query_id, doc_id AS id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN bm25 ON bm25.query_id = item_id AND bm25.id = doc_id""")
def bm25_every_document(spark, sf_dir):
    """Scores of all documents for each question, zeros included, by the stored index."""
    return V.index(spark, sf_dir, "documents").search_all(V.questions(spark, sf_dir))


@query(f"""WITH {V.BM25} SELECT query_id, id, score FROM bm25""")
def bm25_unindexed(spark, sf_dir):
    """The same scores from the texts alone, without an index."""
    corpus = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.bm25(corpus, V.questions(spark, sf_dir))


@query(f"""WITH {V.BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25) SELECT query_id, id, score, rank FROM r WHERE rank <= 5""")
def bm25_topk(spark, sf_dir):
    """E02, F02."""
    return _best(spark, sf_dir, K).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {V.DENSE}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense) SELECT * FROM r WHERE rank <= 5""")
def flat_search(spark, sf_dir):
    """Dense search without a filter."""
    return dense.search(V.vectors(spark, sf_dir), V.question_vectors(spark, sf_dir), K).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {V.DENSE}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense WHERE label = 3) SELECT * FROM r WHERE rank <= 5""")
def metadata_filter_search(spark, sf_dir):
    """The filter's k best; the same as filtering an exact ranking afterwards."""
    found = V.vectors(spark, sf_dir).where(dense.metadata_filter(label=3, fiscal_year=None))
    return dense.search(found, V.question_vectors(spark, sf_dir), K).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {V.DENSE}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense WHERE label IN (1, 2) ) SELECT * FROM r WHERE rank <= 5""")
def prefilter_search(spark, sf_dir):
    """Two labels, filtered before the products."""
    q = V.question_vectors(spark, sf_dir)
    return dense.search(V.vectors(spark, sf_dir).where(F.col("label").isin(1, 2)), q, K).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {V.DENSE} SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dense WHERE query_id = 0 QUALIFY rank <= 10""")
def global_topk(spark, sf_dir):
    """one question's ten best."""
    v = V.vectors(spark, sf_dir)
    best = dense.search(v, V.question_vectors(spark, sf_dir).where("query_id = 0"), 10)
    return best.join(v.select("id", "label"), "id").select("id", "label", "score", F.col("rank").cast("long").alias("rank"))


_FUSED = f"""WITH {V.DENSE}, {V.BM25}, d0 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS dense_rank FROM dense), d AS (SELECT * FROM d0 WHERE dense_rank <= {CANDIDATES}),
l AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS lexical_rank FROM bm25)"""


@query(_FUSED + """, f AS (SELECT d.query_id, d.id, dense_rank, coalesce(lexical_rank, 1000000) AS lexical_rank, round(1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + coalesce(lexical_rank, 1000000)), 9) AS score FROM d LEFT JOIN l ON d.query_id = l.query_id AND d.id = l.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank) AS rank FROM f) SELECT * FROM r WHERE rank <= 5""")
def rrf_global(spark, sf_dir):
    """Dense rank and rank among all documents."""
    near = _dense(spark, sf_dir)
    out = fusion.fuse_ranks(near, _ranks(spark, sf_dir, near), K)
    return out.select("query_id", "id", *(F.col(c).cast("long").alias(c) for c in ("dense_rank", "lexical_rank", "rank")), "score")


@query(_FUSED + """, c AS (SELECT d.query_id, d.id, dense_rank, row_number() OVER (PARTITION BY d.query_id ORDER BY coalesce(l.score, 0) DESC, dense_rank) AS lexical_rank FROM d LEFT JOIN l ON d.query_id = l.query_id AND d.id = l.id),
f AS (SELECT *, round(1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + lexical_rank), 9) AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank) AS rank FROM f) SELECT * FROM r WHERE rank <= 5""")
def rrf_candidates(spark, sf_dir):
    """Dense rank and rank among the candidates."""
    near = _dense(spark, sf_dir)
    out = fusion.fuse_candidates(near, V.index(spark, sf_dir, "documents").scores_of(V.questions(spark, sf_dir), near), K)
    return out.select("query_id", "id", *(F.col(c).cast("long").alias(c) for c in ("dense_rank", "lexical_rank", "rank")), "score")


@query(_FUSED + """, u AS (SELECT query_id, id, dense_rank AS r, 0 AS list FROM d UNION ALL SELECT query_id, id, lexical_rank, 1 FROM l WHERE lexical_rank <= 50),
s AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(list * 10000000 + r) AS seen FROM u GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM s) SELECT query_id, id, score, rank FROM k WHERE rank <= 5""")
def rrf_modes(spark, sf_dir):
    """A sum over the lists that have a document."""
    best = _best(spark, sf_dir, CANDIDATES).drop("rank")
    return fusion.fuse_lists({"dense": _dense(spark, sf_dir), "bm25": best}, K).withColumn("rank", F.col("rank").cast("long"))


@query(_FUSED + """ SELECT d.query_id, d.id, dense_rank, coalesce(lexical_rank, 1000000) AS lexical_rank, round(1.0::DOUBLE / (60 + dense_rank), 9) AS dense_term FROM d LEFT JOIN l ON d.query_id = l.query_id AND d.id = l.id""")
def rank_merge(spark, sf_dir):
    """The two ranks side by side."""
    near = _dense(spark, sf_dir)
    j = fusion.ranked(near, "dense_rank").join(_ranks(spark, sf_dir, near), ["query_id", "id"], "left")
    return j.select("query_id", "id", F.col("dense_rank").cast("long").alias("dense_rank"), F.coalesce("lexical_rank", F.lit(fusion.ABSENT)).cast("long").alias("lexical_rank"), F.round(N.reciprocal_rank(F.col("dense_rank")), 9).alias("dense_term"))


@query(f"""WITH {V.BM25}, {V.SECTIONS} SELECT query_id, id, score FROM bm25 WHERE id IN (SELECT doc_id FROM sections WHERE item = '1A' AND fiscal_year = 2024)""")
def allowed_semi(spark, sf_dir):
    """Candidates in the allowed set."""
    allowed = V.sections(spark, sf_dir).where("item = '1A' AND fiscal_year = 2024").select(F.col("doc_id").alias("id"))
    return _bm25(spark, sf_dir, allowed).select("query_id", "id", "score")


@query("""SELECT b.item_id AS query_id, coalesce(c.text, b.text) AS query, c.text IS NOT NULL AS rewritten FROM benchmark b LEFT JOIN conversations c ON c.conv_id = b.item_id AND c.turn = 0 AND c.role = 'user'""")
def rewrite_fallback(spark, sf_dir):
    """The recorded rewrite, or the question itself."""
    c = V.table(spark, sf_dir, "conversations").where("turn = 0 AND role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("text").alias("rewrite"))
    return V.questions(spark, sf_dir).join(c, "query_id", "left").select("query_id", F.coalesce("rewrite", "text").alias("query"), F.col("rewrite").isNotNull().alias("rewritten"))


@query(f"""WITH {V.VECTORS} SELECT id, len(vector)::BIGINT AS dimension, len(vector) = 64 AS right_dimension, len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AS finite, abs(sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) - 1) <= 1e-5 AS unit FROM vectors""")
def vector_checks(spark, sf_dir):
    """Dimension, finite numbers, unit length."""
    v = V.vectors(spark, sf_dir)
    return v.select("id", F.size("vector").cast("long").alias("dimension"), (F.size("vector") == 64).alias("right_dimension"), F.forall("vector", lambda x: N.finite(x)).alias("finite"), (F.abs(N.norm(F.col("vector")) - 1) <= 1e-5).alias("unit"))


@query(f"""WITH {V.VECTORS} SELECT id, round(vector[1]::DOUBLE / sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])), 6) AS first_component, round(sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])), 6) AS length FROM vectors""")
def l2_normalize(spark, sf_dir):
    """N09."""
    v = V.vectors(spark, sf_dir)
    return v.select("id", F.round(F.element_at(N.normalized(F.col("vector")), 1), 6).alias("first_component"), F.round(N.norm(F.col("vector")), 6).alias("length"))


@query("""SELECT b.item_id AS query_id, count(d.doc_id) AS n_docs, min(d.doc_id) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def text_contains_join(spark, sf_dir):
    """Documents that hold a question's text, by a run of its words as key and then `contains`."""
    q = V.questions(spark, sf_dir)
    found = containment.containing(q, V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")))
    return q.select("query_id").join(found, "query_id", "left").groupBy("query_id").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""WITH a AS (SELECT doc_id, 100 AS start, least(160, n_chars) AS stop FROM documents WHERE n_chars > 100), c AS (SELECT doc_id, unnest(range(0, n_chars, 120)) AS low, n_chars FROM documents)
SELECT a.doc_id, count(*) AS n_cover, min(low) AS low FROM a JOIN c ON c.doc_id = a.doc_id AND low <= start AND least(low + 200, c.n_chars) >= stop GROUP BY 1""")
def span_cover_join(spark, sf_dir):
    """Windows of the same document that cover an anchor's span."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars").where("n_chars > 0")
    a = d.where("n_chars > 100").select("doc_id", F.lit(100).alias("start"), F.least(F.lit(160), "n_chars").alias("stop"))
    c = d.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(120).cast("long"))).alias("low"))
    j = a.join(c, "doc_id").where((F.col("low") <= F.col("start")) & (F.least(F.col("low") + 200, "n_chars") >= F.col("stop")))
    return j.groupBy("doc_id").agg(F.count("*").alias("n_cover"), F.min("low").alias("low"))
