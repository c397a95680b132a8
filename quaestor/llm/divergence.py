"""Source divergence audit: joint count histograms of each pair of a language's sources, a term of the divergence evaluated once for each combination of counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: A term is a run of ASCII letters and of characters beyond ASCII; A-Z count as a-z.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same by bytes of UTF-8: letters in lower case and bytes beyond ASCII stay, all else parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that become terms at once, and terms that a task counts before it passes them on.
PART, HELD = 1 << 20, 500_000
#: Rows of a batch that a task passes on.
ROWS = 20_000
#: Documents of a language that a term must stand in to be kept.
LEAST_DOCS = 10
#: Terms that a group reports.
TOP = 10
#: Probabilities are whole billionths.
UNIT = 1_000_000_000


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly: products have 38 digits, the quotient is a long."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(25,0)) + 2)) DIV (CAST({total} AS DECIMAL(25,0)) + 2 * CAST({terms} AS DECIMAL(25,0)))")


def loss(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most UNIT + 1, so a long holds the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of an UTF-8 text, in parts of about PART bytes that end between terms."""
    plain, at = text.translate(LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + PART)
        yield plain[at : end if end >= 0 else len(plain)].split()
        at = end if end >= 0 else len(plain)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, n, sources, counts): how often each term stands in each source, in parts that are to be summed.

    docs are the documents that have it and n is the sum of counts. Tasks count in tables of at most about HELD terms and
    pass a term's sources on together, so that little is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            parts = []
            for (lang, source), (every, once) in held.items():
                repeated = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(every), dtype=np.int32)), pa.array([x], pa.string())).cast(pa.string())  # noqa: B023, E731
                name = pa.array(list(every), pa.binary()).cast(pa.string())
                found = pa.array(map(once.__getitem__, every), pa.int64(), size=len(every))
                parts.append(pa.table([repeated(lang), name, repeated(source), pa.array(every.values(), pa.int64(), size=len(every)), found], names=["lang", "term", "source", "count", "docs"]))
            held.clear()
            by_term = pa.concat_tables(parts).group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum"), ("count", "sum"), ("source", "list"), ("count", "list")])
            by_term = by_term.select(["lang", "term", "docs_sum", "count_sum", "source_list", "count_list"]).rename_columns(["lang", "term", "docs", "n", "sources", "counts"])
            yield from by_term.to_batches(max_chunksize=ROWS)

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                every, once = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(every), set()
                for part in terms(text.as_py()):
                    every.update(part)
                    seen.update(part)
                once.update(seen)
                size += len(every) - before
                if size >= HELD:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    found = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return found.mapInArrow(run, "lang string, term string, docs long, n long, sources array<string>, counts array<long>")


def joint_counts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, times) for a < b: how many of the language's kept terms stand x times in source a and y times in b.

    kept: (lang, source, term, count), counts of 1 and more. groups: (lang, source, v, ...), v the language's kept terms.
    A term's rows meet themselves: a row for each pair of the sources that have it, summed by (x, y) before the shuffle. The zero cells
    are implied: a's histogram less its joint cells is (x, 0), so too (0, y), and (0, 0) is what is left of v. They
    are signed rows of one sum.
    """
    pair = ["lang", "a", "b"]
    left, right = (kept.select("lang", "term", F.col("source").alias(s), F.col("count").alias(n)) for s, n in (("a", "x"), ("b", "y")))
    joint = left.join(right.hint("merge"), ["lang", "term"]).where("a < b").groupBy(*pair, "x", "y").agg(F.count("*").alias("times"))
    joint = store(joint, "joint")
    zero, less = F.lit(0).cast("long"), (-F.col("times")).alias("times")
    own = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("times"))
    pairs = groups.select("lang", F.col("source").alias("a"), "v").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    size = own.groupBy("lang", "source").agg(F.sum("times").alias("size"))
    sizes = groups.join(size, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", zero).alias("size"))
    rest = pairs.join(sizes.withColumnsRenamed({"source": "a", "size": "in_a"}), ["lang", "a"]).join(sizes.withColumnsRenamed({"source": "b", "size": "in_b"}), ["lang", "b"])
    rows = [
        joint.select(*pair, "x", "y", "times"), joint.select(*pair, "x", zero.alias("y"), less), joint.select(*pair, zero.alias("x"), "y", less), joint.select(*pair, zero.alias("x"), zero.alias("y"), "times"),
        pairs.join(own.withColumnsRenamed({"source": "a", "count": "x"}), ["lang", "a"]).select(*pair, "x", zero.alias("y"), "times"),
        pairs.join(own.withColumnsRenamed({"source": "b", "count": "y"}), ["lang", "b"]).select(*pair, zero.alias("x"), "y", "times"),
        rest.select(*pair, zero.alias("x"), zero.alias("y"), (F.col("v") - F.col("in_a") - F.col("in_b")).alias("times")),
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionAll(part)
    return out.groupBy(*pair, "x", "y").agg(F.sum("times").alias("times")).where("times <> 0")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """How far each (lang, source) group's terms are from the language's other sources and from the language.

    Rows (lang, source, part, item, value, rank). `pair`: item is another source of the language, value the sum of
    loss(p, q) over all kept terms (those in least_docs documents of the language or more), also terms that neither
    has; 0 without kept terms; all ranks. `term`: item is a kept term that the group has and that is likelier there
    than in the language, value its loss(p, q), ranks to `top`. Ranks are by value, then by item in UTF-8 order.

    Null text, lang and source count as empty; groups without terms have pairs; a repeated row counts each time; ids
    and other columns don't matter. No documents: no rows. All sums are whole numbers; a group with a third of all
    rows is summed before each shuffle.
    """
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # dealt by language and term once: what is summed by term, and then by its sources, needs no other shuffle
    of_term = Window.partitionBy("lang", "term")
    found = counts(d).repartition("lang", "term").withColumn("all_docs", F.sum("docs").over(of_term)).withColumn("all", F.sum("n").over(of_term)).withColumn("least", F.min(F.array_min("sources")).over(of_term))
    found = found.where(F.col("all_docs") >= least_docs).select("lang", "term", "all", "least", F.explode(F.arrays_zip("sources", "counts")).alias("s"))
    found = found.groupBy("lang", F.col("s.sources").alias("source"), "term", "all", "least").agg(F.sum("s.counts").alias("count"))
    kept = store(found.select("lang", "source", "term", "count", "all", (F.col("source") == F.col("least")).alias("one")), "kept")
    whole = kept.groupBy("lang").agg(F.count_if("one").alias("v"), F.sum("count").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = d.select("lang", "source").distinct().join(whole, "lang", "left").join(own, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    groups = store(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("v", "lang_n", "n"))), "groups")

    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("n").alias(f"n_{name}"))
    cells = joint_counts(kept, groups).join(side("a").join(groups.select("lang", "v").distinct(), "lang"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    cells = cells.withColumn("p", probability("x", "n_a", "v")).withColumn("q", probability("y", "n_b", "v")).withColumn("f", loss("p", "q"))
    summed = cells.groupBy("lang", "a", "b").agg(F.sum(F.col("f") * F.col("times")).alias("value"))
    pairs = side("a").join(side("b"), "lang").where("a < b").select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", zero))
    pairs = store(pairs.select("lang", "a", "b", "value"), "pairs")
    each = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = kept.join(groups, ["lang", "source"]).withColumn("p", probability("count", "n", "v")).withColumn("q", probability("all", "lang_n", "v")).where("p > q")
    best = terms.select("lang", "source", F.col("term").alias("item"), loss("p", "q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return each.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).select(*names).unionAll(best.withColumn("part", F.lit("term")).select(*names))


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """DuckDB SQL of audit() over documents, term by term."""
    pattern = TERM.replace("'", "''")

    def p(count: str, total: str) -> str:
        return f"(1 + ({UNIT}::HUGEINT * ({count} + 2)) // ({total} + 2 * v))::BIGINT"

    return f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
whole AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS lang_n FROM kept GROUP BY 1),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, {p('coalesce(c.n, 0)', 'g.n')} AS p, {p('k.total', 'w.lang_n')} AS q
 FROM g JOIN whole w ON w.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM cells a JOIN cells b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM cells WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {top}"""
