"""Traces of tool calls: messages of a thread become one row, calls are paired with their results inside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.operators.tools import CONTRACT

# What stands for a call without a result, an answer without a structure, a cut result.
NO_RESULT = "La llamada no produjo un ToolMessage."
NO_STRUCTURE = "El agente terminó sin una respuesta estructurada."
CUT = "… [truncado]"
#: A message. Assistants have calls, invalid_args (arguments that weren't calls), tokens and costs; tools have call_id, status, duration_ms.
CALL = "array<struct<id string, name string, args string>>"
MESSAGE = f"thread_id string, turn long, role string, content string, calls {CALL}, invalid_args array<string>, call_id string, name string, status string, duration_ms double, tokens_in long, tokens_out long, cost double"

_TOOLS = ", ".join(f"'{name}'" for name in sorted(CONTRACT))
_SAID = "filter(messages, m -> m.role = 'assistant')"


def threads(messages: DataFrame) -> DataFrame:
    """(thread_id, messages): a thread's messages (MESSAGE) as an array in the order of their turns; a thread is a conversation, of bounded length."""
    fields = [c for c in messages.columns if c != "thread_id"]
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.struct(*fields).alias("m"))))
    return messages.withColumn("calls", F.coalesce("calls", F.array().cast(CALL))).groupBy("thread_id").agg(F.transform(ordered, lambda x: x["m"]).alias("messages"))


def calls(of: DataFrame) -> DataFrame:
    """threads() with `calls`: array of (id, name, args, success, error, result, chunk_ids, duration_ms), in the order they were made.

    Calls of the four tools alone. A call without an id is named by its tool and its place in its message. Its result is the last
    tool message of that id: none is an error, and so is one whose status is `error`. Only a search has chunk ids.
    """
    asked = f"flatten(transform({_SAID}, m -> transform(m.calls, (c, i) -> named_struct('id', coalesce(nullif(c.id, ''), concat(c.name, '-', i)), 'name', c.name, 'args', c.args))))"
    paired = f"transform(filter({asked}, c -> c.name IN ({_TOOLS})), c -> named_struct('c', c, 'r', try_element_at(filter(messages, m -> m.role = 'tool' AND m.call_id = c.id), -1)))"
    out = of.withColumn("calls", F.expr(paired))

    def call(x):
        text, error = F.coalesce(x["r"]["content"], F.lit("")), F.coalesce(x["r"]["status"] == "error", F.lit(False))
        cut = T.truncated(text, mark=CUT)
        there = x["r"].isNotNull()
        ids = F.when(there & (x["c"]["name"] == "search_filings"), T.hit_ids(text)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            x["c"]["id"].alias("id"), x["c"]["name"].alias("name"), x["c"]["args"].alias("args"), (there & ~error).alias("success"), F.when(~there, NO_RESULT).when(error, cut).alias("error"), F.when(there & ~error, cut).alias("result"),
            ids.alias("chunk_ids"), F.when(there, F.coalesce(x["r"]["duration_ms"], F.lit(0.0))).otherwise(F.lit(0.0)).alias("duration_ms"))

    return out.withColumn("calls", F.transform("calls", call))


def answers(of: DataFrame, structured: DataFrame) -> DataFrame:
    """(thread_id, respuesta, cifra, unidad, fuente, cita, chunk_id, calls, tokens_in, tokens_out, cost, error) of calls().

    structured: the answers (thread_id and those fields) of threads that ended with one; the others answer with their last
    assistant message's text, or nothing, and have an error. Tokens and costs are sums, null if no message tells any.
    """
    total = lambda field, zero: F.expr(f"aggregate(filter(transform({_SAID}, m -> m.{field}), x -> x IS NOT NULL), cast(NULL AS {zero}), (s, x) -> coalesce(s, 0) + x)")
    s = structured.select("thread_id", F.struct("respuesta", "cifra", "unidad", "fuente", F.nullif(F.trim("cita"), F.lit("")).alias("cita"), "chunk_id").alias("s"))
    last = F.expr(f"coalesce(try_element_at({_SAID}, -1).content, '')")
    none = F.struct(last.alias("respuesta"), F.lit(None).cast("double").alias("cifra"), F.lit(None).cast("string").alias("unidad"), F.lit("ninguna").alias("fuente"), F.lit(None).cast("string").alias("cita"), F.lit(None).cast("string").alias("chunk_id"))
    out = of.join(s, "thread_id", "left").withColumn("a", F.coalesce("s", none))
    return out.select("thread_id", "a.*", "calls", total("tokens_in", "bigint").alias("tokens_in"), total("tokens_out", "bigint").alias("tokens_out"), total("cost", "double").alias("cost"), F.when(F.col("s").isNull(), NO_STRUCTURE).alias("error"))


def retrieved(calls_column: str = "calls", k: int | None = None) -> str:
    """SQL: the different chunk ids of successful searches, in order; with k, of the first k of each call."""
    ids = "c.chunk_ids" if k is None else f"slice(c.chunk_ids, 1, {int(k)})"
    return f"array_distinct(flatten(transform(filter({calls_column}, c -> c.name = 'search_filings' AND c.success), c -> {ids})))"


def anchor_recall(of: DataFrame, anchors: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(thread_id, n_chunks, recall): 1 if a chunk among the first k of any successful search of calls() holds the thread's whole anchor, else 0.

    anchors: (thread_id, anchor); without one (null) recall is 0. chunks: (chunk_id, texto). Ids that no chunk has count as not found.
    """
    own = of.join(anchors, "thread_id").select("thread_id", "anchor", F.expr(retrieved(k=k)).alias("ids"))
    pairs = own.select("thread_id", "anchor", F.explode("ids").alias("chunk_id")).join(chunks.select("chunk_id", "texto"), "chunk_id")
    held = pairs.where(F.contains("texto", F.col("anchor"))).select("thread_id").distinct().withColumn("held", F.lit(1.0))
    return own.join(held, "thread_id", "left").select("thread_id", F.size("ids").alias("n_chunks"), F.coalesce("held", F.lit(0.0)).alias("recall"))
