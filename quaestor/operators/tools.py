"""The four evidence tools as one object over DataFrames: catalogue, facts, sections, search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import numeric as N
from quaestor.operators import dense

NOT_FOUND = "not available"


def checked(query: str, k: int, ticker: str | None = None, fiscal_year: int | None = None, item: str | None = None) -> dict:
    """A search's arguments in normal form; raises ValueError for what can't be."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query is empty")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive whole number")
    if isinstance(fiscal_year, bool):
        raise ValueError("the year must be a number")
    for name, value in (("ticker", ticker), ("item", item)):
        if value is not None and not value.strip():
            raise ValueError(f"the {name} is blank; leave it out to search all")
    upper = lambda s: None if s is None else s.strip().upper()
    return {"query": query.strip(), "k": k, "ticker": upper(ticker), "fiscal_year": None if fiscal_year is None else int(fiscal_year), "item": upper(item)}


# The four tools, the arguments that each takes and those of them that it can't do without.
CONTRACT = {
    "list_available": (set(), set()),
    "get_xbrl_fact": ({"ticker", "fiscal_year", "concept"}, {"ticker", "fiscal_year", "concept"}),
    "search_filings": ({"query", "ticker", "fiscal_year", "item", "k"}, {"query"}),
    "read_section": ({"ticker", "fiscal_year", "item"}, {"ticker", "fiscal_year", "item"}),
}


def contract_problems(schemas: dict[str, dict]) -> list[str]:
    """What sets tools, given by name with their JSON schemas, apart from CONTRACT; nothing if they are the same."""
    out = [f"{name}: missing" for name in sorted(CONTRACT.keys() - schemas.keys())]
    out += [f"{name}: unknown" for name in sorted(schemas.keys() - CONTRACT.keys())]
    for name in sorted(CONTRACT.keys() & schemas.keys()):
        for what, own, wanted in zip(("arguments", "required"), (schemas[name].get("properties", {}), schemas[name].get("required", ())), CONTRACT[name], strict=True):
            if set(own) != wanted:
                out.append(f"{name}: {what} {sorted(own)}, not {sorted(wanted)}")
    return out


def encoded(queries: DataFrame, encoder: Callable[[DataFrame], DataFrame], prefix: str = "", dimension: int | None = None) -> DataFrame:
    """(query_id, vector): the encoder's vectors of queries with `prefix` before them, at length 1, as floats.

    Raises ValueError if a query has no vector or several, or one of another dimension, of zeros or of numbers that aren't finite.
    """
    v = encoder(queries.select("query_id", F.concat(F.lit(prefix), "text").alias("text"))).select("query_id", "vector").persist()
    right = F.size("vector") > 0 if dimension is None else F.size("vector") == dimension
    wrong = v.where(~F.coalesce(right & N.normalized(F.col("vector")).isNotNull() & F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    first = wrong.select("query_id").limit(1).collect()
    if first:
        raise ValueError(f"the encoder's vector of query {first[0][0]} isn't {dimension or 'a number of'} finite components")
    unlike = queries.select("query_id").join(v.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "full_outer").where("n IS NULL OR n <> 1").limit(1).collect()
    if unlike:
        raise ValueError(f"the encoder didn't give one vector for query {unlike[0][0]}")
    return v.select("query_id", N.normalized(F.col("vector")).cast("array<float>").alias("vector"))


def rewritten(queries: DataFrame, rewrite: Callable[[str], str], recorded: DataFrame | None = None) -> DataFrame:
    """(query_id, text, error): each query by rewrite(text), run in Arrow batches; where it fails or gives nothing, the recorded one or itself.

    recorded: (query_id, text). error names the failure of a query, whatever it was; the other queries go on. A blank query
    isn't rewritten.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new, errors = [], []
            for text in batch["text"]:
                try:
                    made = rewrite(text.strip()).strip()
                    if not made:
                        raise ValueError("an empty rewrite")
                    new.append(made)
                    errors.append(None)
                except Exception as wrong:  # any failure of a model falls back
                    new.append(None)
                    errors.append(f"{type(wrong).__name__}: {wrong}")
            yield pd.DataFrame({"query_id": batch["query_id"], "new": pd.Series(new, dtype="object"), "error": pd.Series(errors, dtype="object")})

    asked = queries.where(F.trim("text") != "").select("query_id", "text")
    new = asked.mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, new string, error string")
    old = recorded.select("query_id", F.col("text").alias("old")) if recorded is not None else queries.select("query_id", F.lit(None).cast("string").alias("old")).limit(0)
    out = queries.select("query_id", "text").join(new, "query_id", "left").join(old, "query_id", "left")
    return out.select("query_id", F.coalesce("new", "old", "text").alias("text"), "error")


@dataclass
class Evidence:
    """Tables and an encoder (texts to vectors: a DataFrame (query_id, text) to (query_id, vector)) behind the tools."""

    sections: DataFrame
    facts: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    encoder: Callable[[DataFrame], DataFrame]
    rewriter: Callable[[DataFrame], DataFrame] | None = None
    query_prefix: str = ""
    dimension: int | None = None

    def catalog(self) -> DataFrame:
        s = self.sections.groupBy("ticker", "fiscal_year").agg(F.sort_array(F.collect_set("item")).alias("items"))
        return s.orderBy("ticker", "fiscal_year")

    def fact(self, ticker: str, fiscal_year: int, concept: str) -> DataFrame:
        one = self.facts.where((F.col("ticker") == ticker) & (F.col("fiscal_year") == int(fiscal_year)) & (F.col("concept") == concept))
        return one.orderBy("value", "unit").limit(1).select("ticker", "fiscal_year", "concept", "value", "unit", F.concat("concept", F.lit(" = "), F.format_number("value", 0), F.lit(" "), "unit").alias("rendered"))

    def section(self, ticker: str, fiscal_year: int, item: str) -> DataFrame:
        one = self.sections.where((F.col("ticker") == ticker) & (F.col("fiscal_year") == int(fiscal_year)) & (F.col("item") == item)).limit(1)
        return one.agg(F.coalesce(F.first("texto"), F.lit(NOT_FOUND)).alias("texto"))

    def search(self, queries: DataFrame, k: int = 5, flat: bool = False, **wanted) -> DataFrame:
        """(query_id, id, score, rank): a batch of queries (query_id, text); flat leaves the filter out. Arguments are checked first."""
        known = checked("a batch", k, **{c: wanted.get(c) for c in ("ticker", "fiscal_year", "item")})
        wanted |= {c: v for c, v in known.items() if c in wanted}
        if self.rewriter:
            new = self.rewriter(queries).select("query_id", F.nullif(F.trim("text"), F.lit("")).alias("new"))
            queries = queries.join(new, "query_id", "left").select("query_id", F.coalesce("new", "text").alias("text"))
        v = self.vectors if flat else self.vectors.join(self.chunks.where(dense.metadata_filter(**wanted)).select(F.col("chunk_id").alias("id")), "id", "left_semi")
        return dense.search(v, encoded(queries, self.encoder, self.query_prefix, self.dimension), k)
