"""Repeated and near-repeated passages: compact windows of token min-hashes, interval joins, verified runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, map_parts, store
from .minhash import mix, shingle_hashes, text_hashes

#: Words of a token (a shingle), least words of a passage, and least tokens of a window from that.
SHINGLE, PASSAGE = 5, 50
WINDOW = PASSAGE - SHINGLE + 1
#: Min-hashes, and in shared windows of how many of them a place must be to be verified: at a similarity of 0.8 two
#: passages have two of four in common with probability 0.97.
HASHES, ENOUGH = 4, 2
#: A run has so many tokens (12 words); of so many neighbouring runs at least one is looked up. At a similarity of 0.8
#: changed words lie 45 apart on average, so that what is between them has runs.
RUN, SPARSE = 8, 6
#: Runs with at most so many tokens between them, where words were changed, are one chain.
GAP = 24
SIMILARITY = 0.8
#: A passage without changes is reached over by so many tokens of runs at least, one with changes by so many.
REACH, REACH_CHANGED = WINDOW - 2 * (SPARSE - 1), 20
#: Tokens beside a chain that are read with it, as a change near an end leaves no run beyond it.
BESIDE = 64


def _sliding(f, values: np.ndarray, width: int) -> np.ndarray:
    """The least or the greatest (f) of each `width` neighbours along the last axis, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = f(values[..., :-step], values[..., step:]), have + step
    return values


def minima(values: np.ndarray, least: int = WINDOW) -> np.ndarray:
    """Whether a place is the minimum of some `least` neighbours (along the last axis)."""
    if values.shape[-1] < least:
        return np.zeros(values.shape, dtype=bool)
    beside = [(0, 0)] * (values.ndim - 1) + [(least - 1, least - 1)]
    return _sliding(np.maximum, np.pad(_sliding(np.minimum, values, least), beside), least) == values


def compact_windows(values: np.ndarray, least: int = WINDOW, at: np.ndarray | None = None) -> np.ndarray:
    """Rows (left, place, right), one for each node of the Cartesian tree over the values whose span has `least` or more.

    Every stretch within a span that holds the place has its minimum there, so the spans with their places stand for all
    stretches of `least` tokens or more. Of equal values the first is taken. Such a node is the minimum of `least`
    neighbours, and so are those that end its span; so the tree's stack need only see these (`at`: their places).
    """
    at = np.flatnonzero(minima(values, least)) if at is None else at
    places, own = at.tolist(), values[at].tolist()
    left, right, open_ = [0] * len(places), [len(values) - 1] * len(places), []
    for i, value in enumerate(own):
        while open_ and own[open_[-1]] > value:
            right[open_.pop()] = places[i] - 1
        if open_:
            left[i] = places[open_[-1]] + 1
        open_.append(i)
    out = np.array([left, places, right], dtype=np.int64).T
    return out[out[:, 2] - out[:, 0] + 1 >= least]


def windows(docs: DataFrame) -> DataFrame:
    """(key, doc_id, place, before, after): the windows of each hash, by the hashed token that they share.

    The lowest bits of a key say which of the hashes it is.
    """
    names = ["key", "doc_id", "place", "before", "after"]

    def frame(parts: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*parts, strict=True), strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = np.array([[(i + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1] for i in range(HASHES)], dtype=np.uint64)
        parts, n = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = text_hashes(text)
                if len(own) < PASSAGE or pd.isna(doc_id):
                    continue
                tokens = shingle_hashes(own, SHINGLE)
                hashes = mix(tokens ^ seeds)
                for i, (values, lowest) in enumerate(zip(hashes, minima(hashes), strict=True)):
                    at = compact_windows(values, at=np.flatnonzero(lowest))
                    left, place, right = at.T.astype(np.int32)
                    key = values[place] & np.uint64(~(HASHES - 1) & (1 << 64) - 1) | np.uint64(i)
                    parts.append((key.view(np.int64), np.full(len(at), doc_id), place, place - left, right - place))
                    n += len(at)
                if n > 50_000:
                    yield frame(parts)
                    parts, n = [], 0
        if parts:
            yield frame(parts)

    return map_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "key long, doc_id long, place int, before int, after int")


def candidate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): stretches of tokens that lie in windows shared with other documents, by ENOUGH of the hashes.

    Windows of one key hold the same token. What two of them can share reaches as far to each side of it as both do;
    against all others of the key, as far as the window itself and the farthest of the key. Stretches under WINDOW
    tokens are no candidates. The key's figures are pre-aggregated and joined back; no pairs are made. So a place is
    a candidate wherever it would be one with some other document; which one that is, verification finds.
    """
    w = store(windows(docs), "windows")
    shared = store(w.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("before").alias("most_before"), F.max("after").alias("most_after")).where("low <> high").drop("low", "high"), "shared")  # a table of its own: then the join's hot keys can be split
    s = w.join(shared.hint("merge"), "key").select("doc_id", F.pmod("key", F.lit(HASHES)).alias("hash"), (F.col("place") - F.least("before", "most_before")).alias("from"), (F.col("place") + F.least("after", "most_after") + 1).alias("to"))
    s = s.where(F.col("to") - F.col("from") >= WINDOW)
    # spans of one hash that touch become one; then a sweep counts the hashes over each place
    order = Window.partitionBy("doc_id", "hash").orderBy("from", "to")
    s = s.withColumn("reached", F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.coalesce((F.col("from") > F.col("reached")).cast("int"), F.lit(1)))
    s = s.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "hash", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    edges = s.select("doc_id", F.explode(F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("step")), F.struct(F.col("to").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("doc_id", "e.*")
    edges = edges.groupBy("doc_id", "at").agg(F.sum("step").alias("step"))
    sweep = Window.partitionBy("doc_id").orderBy("at")
    edges = edges.withColumn("within", F.sum("step").over(sweep) >= ENOUGH)
    edges = edges.withColumn("was", F.coalesce(F.lag("within").over(sweep), F.lit(False))).where("within <> was").withColumn("to", F.lead("at").over(sweep))
    spans = edges.where(F.col("within") & (F.col("to") - F.col("at") >= WINDOW))
    spans = store(spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("from"), "to"))).alias("spans")), "spans")
    drop(w)
    drop(shared)
    return spans


def _run_hashes(tokens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each RUN (a power of two) tokens, by doubling."""
    width = 1
    while width < RUN:
        tokens = mix(tokens[:-width] * np.uint64(0x9E3779B97F4A7C15) + tokens[width:])
        width *= 2
    return tokens


def sparse_runs(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs to look up: the smallest of each SPARSE neighbours within the spans, and the text's first and last.

    What is taken hangs on the content alone, so equal stretches of RUN + SPARSE - 1 tokens have one in common.
    """
    hashes = _run_hashes(tokens)
    take = np.zeros(len(hashes), dtype=bool)
    for low, high in spans:
        high = min(high - RUN + 1, len(hashes))
        if high - low >= SPARSE:
            view = np.lib.stride_tricks.sliding_window_view(hashes[low:high], SPARSE)
            take[low + np.arange(len(view)) + view.argmin(axis=1)] = True
        elif high > low:
            take[low + int(hashes[low:high].argmin())] = True
        for end in (0, len(hashes) - 1):
            take[end] |= low <= end < high
    at = np.flatnonzero(take)
    return at, hashes[at]


def runs(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, doc_id, at, tokens) of each document with candidate spans: the runs to look up, by their hash, and the spans' own tokens (32 bits of each), without a key."""

    def frame(parts: list[tuple]) -> pd.DataFrame:
        key, doc_id, at, tokens = zip(*parts, strict=True)
        return pd.DataFrame({"key": pd.Series([k for ks in key for k in ks], dtype="Int64"), "doc_id": np.concatenate(doc_id), "at": np.concatenate(at), "tokens": [t for ts in tokens for t in ts]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, n = [], 0
        for batch in batches:
            for doc_id, text, own in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                joined: list[list[int]] = []
                for s in own:
                    if joined and s["from"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s["to"])
                    else:
                        joined.append([s["from"], s["to"]])
                hashes = shingle_hashes(text_hashes(text), SHINGLE)
                at, key = sparse_runs(hashes, joined)
                short = hashes.astype(np.uint32)
                parts.append((key.view(np.int64).tolist() + [None] * len(joined), np.full(len(at) + len(joined), doc_id), np.append(at, [low for low, _ in joined]), [None] * len(at) + [short[low:high].tobytes() for low, high in joined]))
                n += len(at)
                if n > 50_000:
                    yield frame(parts)
                    parts, n = [], 0
        if parts:
            yield frame(parts)

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(spans.hint("merge"), "doc_id")
    return map_parts(both, run, "key long, doc_id long, at int, tokens binary")


def alike_parts(own: np.ndarray, other: np.ndarray, shift: int, shift_end: int, least: int = WINDOW) -> list[tuple[int, int, int]]:
    """(low, high, place in other) of the longest parts of own, of `least` tokens or more, that are as similar to a part of other as SIMILARITY.

    Tokens of own are matched with equal ones of other, on one of the two diagonals first. Matched stretches are joined
    one after another over at most GAP tokens while what they span together is alike: matched tokens by those of both.
    """
    place = np.arange(len(own))
    order = np.argsort(other, kind="stable")
    to = order[np.minimum(np.searchsorted(other[order], own), len(other) - 1)]
    for diagonal in (shift_end, shift):
        straight = np.clip(place + diagonal, 0, len(other) - 1)
        to = np.where(other[straight] == own, straight, to)
    matched = np.flatnonzero(other[to] == own)
    if not len(matched):
        return []
    breaks = np.flatnonzero((np.diff(matched) != 1) | (np.diff(to[matched]) != 1)) + 1
    done: list[tuple[int, int, int, int, int]] = []  # of both sides where a part begins and ends, and its matched tokens
    for stretch in np.split(matched, breaks):
        part = int(stretch[0]), int(stretch[-1]) + 1, int(to[stretch[0]]), int(to[stretch[-1]]) + 1, len(stretch)
        while done:
            a = done[-1]
            n, all_ = a[4] + part[4], part[1] - a[0] + part[3] - a[2]
            if not (0 <= part[2] - a[3] <= 2 * GAP and part[0] - a[1] <= GAP and n >= SIMILARITY * (all_ - n)):
                break
            part = a[0], part[1], a[2], part[3], n
            done.pop()
        done.append(part)
    return [(low, high, there) for low, high, there, _, _ in done if high - low >= least]


def _verified(chains: DataFrame, read: DataFrame) -> DataFrame:
    """Of chains with holes, or too short to be passages by their runs alone, the parts that are alike: (doc_id, low, high, first_doc_id, first_from, ids)."""
    spans = read.where("tokens is not null").select(F.col("doc_id").alias("_doc"), F.col("at").alias("span"), "tokens", (F.col("at") + F.length("tokens") / 4).cast("int").alias("span_to"))

    def sliced(rows: DataFrame, doc: str, low: str, high: str, to: str) -> DataFrame:
        meets = (F.col(doc) == F.col("_doc")) & (F.col("span") < F.col(high)) & (F.col("span_to") > F.col(low))
        start = F.greatest(F.lit(0), F.col(low) - BESIDE - F.col("span"))
        cut = rows.join(spans.hint("merge"), meets).withColumn(f"{to}_at", F.col("span") + start)
        return cut.withColumn(to, F.substring("tokens", 4 * start + 1, 4 * (F.col(high) - F.col(low) + 2 * BESIDE))).drop("_doc", "span", "span_to", "tokens")

    rows = sliced(sliced(chains, "doc_id", "low", "high", "own"), "first_doc_id", "first_low", "first_high", "other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                own, other = np.frombuffer(r.own, dtype=np.uint32), np.frombuffer(r.other, dtype=np.uint32)
                if len(own) and len(other):
                    turn = r.own_at - r.other_at
                    for low, high, there in alike_parts(own, other, r.shift + turn, r.shift_end + turn):
                        out.append((r.doc_id, r.own_at + low, r.own_at + high, r.first_doc_id, r.other_at + there, r.ids))
            yield pd.DataFrame(out, columns=["doc_id", "low", "high", "first_doc_id", "first_from", "ids"])

    return rows.select("doc_id", "first_doc_id", "shift", "shift_end", "own", "own_at", "other", "other_at", "ids").mapInPandas(run, "doc_id long, low int, high int, first_doc_id long, first_from int, ids array<long>")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages that earlier documents have too: doc_id, word_from, word_to (exclusive), n_words, first_doc_id, first_from, earlier_doc_ids.

    A run's document is the smallest doc_id that has it; so what is repeated stays in one document. Equal runs of 12
    words make stretches; those of REACH tokens or more are passages as they are. Stretches with at most GAP tokens
    between them are a chain, which is held against each document of its runs: its parts of PASSAGE words or more with a
    similarity of 0.8 or more by their shingles are passages. Passages that touch are one. first_doc_id has the passage's
    beginning, earlier_doc_ids are all documents of its runs.

    Every passage of PASSAGE words or more that two documents share word for word gives a row; what they share in under
    40 words doesn't. Ends of what has no changes can be up to 5 words short, but for a text's own first and last words.
    Changed passages without an unchanged stretch of PASSAGE words are found if two of the four min-hashes agree, with
    a probability of 0.97 at a similarity of 0.8, and if runs reach over REACH_CHANGED tokens.
    Null ids and texts, and texts of under PASSAGE words, have no passages; rows of one id count as one document.
    Repeats within a document are not reported.
    """
    read = store(runs(docs, candidate_spans(docs)), "runs")
    docs.sparkSession._jvm.System.gc()
    found = read.where("key is not null").drop("tokens")
    first = store(found.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last").select("key", F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_at")), "first")
    again = found.join(first.hint("merge"), "key").where("doc_id <> first_doc_id").select("doc_id", "first_doc_id", "at", "first_at").distinct()
    order = Window.partitionBy("doc_id").orderBy("at", "first_doc_id", "first_at")
    hole = F.coalesce(F.col("at") - F.lag("at").over(order) - RUN, F.lit(GAP + 1))
    again = again.withColumn("hole", hole)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    again = again.withColumn("chain", F.sum((F.col("hole") > GAP).cast("int")).over(upto)).withColumn("stretch", F.sum((F.col("hole") > 0).cast("int")).over(upto))
    ends = [f(c).alias(n) for n, f, c in (("low", F.min, "at"), ("high", F.max, "at"), ("n", F.count, "at"))]
    parts = again.groupBy("doc_id", "chain", "stretch", "first_doc_id").agg(*ends, F.min_by("first_at", "at").alias("first_low"), F.max_by("first_at", "at").alias("first_high"))
    parts = store(parts, "parts")
    beyond = F.max("high") + RUN
    plain = parts.groupBy("doc_id", "stretch").agg(F.min("low").alias("low"), beyond.alias("high"), F.min_by(F.struct("first_doc_id", "first_low"), F.struct("low", "first_doc_id")).alias("f"), F.collect_set("first_doc_id").alias("ids"))
    plain = plain.where(F.col("high") - F.col("low") >= REACH).select("doc_id", "low", "high", F.col("f.first_doc_id").alias("first_doc_id"), F.col("f.first_low").alias("first_from"), "ids")
    # a chain and each document of its runs, with where it begins and ends in both
    by_first = parts.groupBy("doc_id", "chain", "first_doc_id").agg(
        F.min("low").alias("low"), beyond.alias("high"), F.count("*").alias("stretches"),
        (F.min_by("first_low", "low") - F.min("low")).alias("shift"), (F.max_by("first_high", "high") - F.max("high")).alias("shift_end"),
        F.min("first_low").alias("first_low"), (F.max("first_high") + RUN).alias("first_high"),
    )
    each = F.collect_list(F.struct("first_doc_id", "shift", "shift_end", "first_low", "first_high", F.col("low").alias("own_low"), F.col("high").alias("own_high"))).alias("each")
    chains = by_first.groupBy("doc_id", "chain").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("stretches").alias("stretches"), F.count("*").alias("firsts"), F.collect_set("first_doc_id").alias("ids"), each)
    reach = F.col("high") - F.col("low")
    chains = chains.where((reach >= REACH_CHANGED) & ((reach < REACH) | (F.col("stretches") > 1) | (F.col("firsts") > 1)))
    chains = chains.withColumn("m", F.explode("each")).select("doc_id", "low", "high", "ids", "m.first_doc_id", "m.shift", "m.shift_end", (F.col("m.first_low") - (F.col("m.own_low") - F.col("low"))).alias("first_low"), (F.col("m.first_high") + (F.col("high") - F.col("m.own_high"))).alias("first_high"))
    both = plain.unionByName(_verified(chains, read))
    order = Window.partitionBy("doc_id").orderBy("low", "high", "first_doc_id")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("new", F.coalesce((F.col("low") > reached).cast("int"), F.lit(1))).withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = both.groupBy("doc_id", "passage").agg(F.min("low").alias("word_from"), (F.max("high") + SHINGLE - 1).alias("word_to"), F.min_by(F.struct("first_doc_id", "first_from"), F.struct("low", "first_doc_id")).alias("f"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("earlier_doc_ids"))
    return out.select("doc_id", "word_from", "word_to", (F.col("word_to") - F.col("word_from")).alias("n_words"), F.col("f.first_doc_id").alias("first_doc_id"), F.col("f.first_from").alias("first_from"), "earlier_doc_ids")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated passages cut from their texts; rows whose text loses all of its words go.

    Other rows and columns stay as they are, but for n_chars, which follows the text.
    """
    cut = store(repeated_passages(docs).groupBy("doc_id").agg(F.collect_list(F.struct("word_from", "word_to")).alias("cuts")), "cuts")
    docs.sparkSession._jvm.System.gc()  # as in drop(): before the texts move once more
    joined = docs.join(cut.withColumnRenamed("doc_id", "_id").hint("merge"), F.col("doc_id") == F.col("_id"), "left").drop("_id")

    @F.pandas_udf("string")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, cuts in batches:
            yield pd.Series([_cut(t, [(c["word_from"], c["word_to"]) for c in own]) for t, own in zip(texts, cuts, strict=True)], dtype="object")

    whole, cutting = joined.where("cuts is null").drop("cuts"), joined.where("cuts is not null")
    shorter = cutting.withColumn("text", rest("text", "cuts")).where(F.length("text") > 0).drop("cuts")
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.length("text").cast("long"))
    return whole.unionByName(shorter)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space before each."""
    raw = text.encode("utf-8", "surrogatepass")
    white = np.isin(np.frombuffer(raw, dtype=np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
    ends = np.flatnonzero(~white & np.append(white[1:], True)) + 1
    starts = np.append(0, ends[:-1])
    keep = np.ones(len(ends), dtype=bool)
    for a, b in spans:
        keep[a:b] = False
    return b"".join(raw[starts[i] : ends[i]] for i in np.flatnonzero(keep)).decode("utf-8", "surrogatepass").strip(" \t\n\x0b\x0c\r")
