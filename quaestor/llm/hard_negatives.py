"""Hard negatives: each anchor's integer scores with all rows are sorted, and each positive's limit is looked up by bisection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Components become whole numbers: floor(SCALE * x).
SCALE = 256
#: Rows and anchors of a block at most; a corpus of under BLOCKS * BLOCK rows has BLOCKS blocks, or blocks of LEAST rows.
BLOCK, LEAST, BLOCKS = 16_384, 512, 64
#: Scores that are held at once.
SCORES = 4_000_000
#: Doubles add whole numbers exactly below this.
EXACT = 2.0**53
#: Scores beyond a long become its ends.
MOST = 2**63 - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers in doubles, exactly, as longs."""
    size = [np.abs(x).max(initial=0) for x in (a, b)]
    if size[0] * size[1] * a.shape[1] < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.floor(SCALE * np.array(column.tolist(), dtype=np.float64))


def _slices(anchors: pd.DataFrame, block: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Anchors, as many at a time as SCORES allows, with their scores with the block's rows."""
    vectors = _matrix(block["vector"])
    step = max(1, SCORES // len(block))
    for at in range(0, len(anchors), step):
        part = anchors.iloc[at : at + step]
        yield part, products(_matrix(part["vector"]), vectors)


def _by_length(anchors: pd.DataFrame, block: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Vectors meet those of their length; a block's rows in the order of their ids, so that a stable sort breaks ties."""
    rows = {length: part.sort_values("id", ignore_index=True) for length, part in block.groupby(block["vector"].map(len))}
    for length, part in anchors.groupby(anchors["vector"].map(len)):
        if length in rows:
            yield part, rows[length]


def find_positives(anchors: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of the block's rows of each anchor's label, without itself: anchor_id, positive_id, score."""
    out = [pd.DataFrame({"anchor_id": [], "positive_id": [], "score": []}, dtype=np.int64)]
    for some, rows in _by_length(anchors, block):
        for label, own in some.groupby("label"):
            same = rows[rows["label"] == label].reset_index(drop=True)
            if not len(same):
                continue
            ids = same["id"].to_numpy()
            for part, s in _slices(own, same):
                best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                name = np.repeat(part["id"].to_numpy(), best.shape[1])
                found = pd.DataFrame({"anchor_id": name, "positive_id": ids[best.ravel()], "score": np.take_along_axis(s, best, axis=1).ravel()})
                out.append(found[found["anchor_id"] != found["positive_id"]].groupby("anchor_id").head(k))
    return pd.concat(out, ignore_index=True)


def find_negatives(anchors: pd.DataFrame, block: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """For each positive of each anchor the k best rows of the block with another label, a score of at most the positive's and at least its percentage.

    All of an anchor's scores with the block are sorted, best first, ties by id; a bisection finds where a positive's
    limit stands, and k entries with other labels are read from there, down to the lower limit.
    """
    out = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "score")}
    for some, rows in _by_length(anchors, block):
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        for part, scores in _slices(some, rows):
            order = np.argsort(-scores, axis=1, kind="stable")
            for name, label, positives, limits, s, best in zip(part["id"], part["label"], part["positive_ids"], part["positive_scores"], scores, order, strict=True):
                best = best[labels[best] != label]
                falling = -s[best]
                for positive, upper in zip(positives.tolist(), limits.tolist(), strict=True):
                    lower = -((-upper * percent) // 100)
                    first, last = np.searchsorted(falling, -upper, "left"), np.searchsorted(falling, -lower, "right")
                    taken = best[first : min(last, first + k)]
                    out["anchor_id"] += [name] * len(taken)
                    out["positive_id"] += [positive] * len(taken)
                    out["positive_score"] += [upper] * len(taken)
                    out["negative_id"] += ids[taken].tolist()
                    out["score"] += s[taken].tolist()
    return pd.DataFrame(out, dtype=np.int64)


def _pairs(anchors: DataFrame, rows: DataFrame, width: int, n_anchor_blocks: int, run, schema: str) -> DataFrame:
    """run(anchors, rows) for each pair of a block of anchors and one of rows; both are dealt by a hash of their ids, and each goes to all blocks of the other."""
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("ab", dealt(n_anchor_blocks)).withColumn("rb", every(width))
    right = rows.withColumn("rb", dealt(width)).withColumn("ab", every(n_anchor_blocks))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInPandas(run, schema)


def mine(vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, percent: int = 80, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Hard negatives of each anchor: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(SCALE * x); a score is the whole-number inner product. An anchor (a row for which the SQL
    condition `anchor` on the id holds) has as positives its `positives` best other rows of its label. For each of
    them, the `negatives` best rows of another label whose score is at most the positive's and at least `percent`
    hundredths of it are ranked from 1. Ties go to the smaller id. A positive of a negative score has none.

    Rows with a null id, label or vector, an empty vector, or a component that is null or (also SCALE times) not
    finite take no part. Vectors of other lengths than the anchor's don't meet it. Of rows with one id the one with
    the least label and vector takes part, once. Scores beyond a long become its ends. No anchors: no rows.

    Each pair of a block of anchors and a block of rows (BLOCK each at most) is one task's matrix product, first for
    the positives, then for the negatives; blocks are by hash, so that labels of many rows or equal vectors change
    nothing. A task keeps k for each anchor, or each of its positives; a window keeps k of those.
    """
    kind = "double" if dict(vectors.dtypes)[vector] == "array<double>" else "float"
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    v = v.where("id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0").where(finite)
    v = store(v.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*"), "vectors")
    anchors = v.where(anchor)
    blocks = lambda n: max(1, -(-n // max(LEAST, min(BLOCK, n // BLOCKS))))
    width, n_anchor_blocks = blocks(v.count()), max(1, -(-anchors.count() // BLOCK))

    found = _pairs(anchors, v, width, n_anchor_blocks, lambda a, b: find_positives(a, b, positives), "anchor_id long, positive_id long, score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    own = found.groupBy("anchor_id").agg(F.collect_list("positive_id").alias("positive_ids"), F.collect_list("score").alias("positive_scores"))
    asking = store(anchors.join(own, F.col("id") == F.col("anchor_id")).select("id", "label", "vector", "positive_ids", "positive_scores"), "anchors")

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, score long"
    hard = _pairs(asking, v, width, n_anchor_blocks, lambda a, b: find_negatives(a, b, negatives, percent), schema)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def oracle() -> str:
    """DuckDB SQL of op12 over embeddings."""
    return f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND len(a.v) > 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
