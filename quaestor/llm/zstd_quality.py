"""Quality classifier by compression: which of two zstandard dictionaries, of good or of bad text, helps a text more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, store

#: At most so many labelled rows of each class are learnt from: a bound of the model, whatever the table's size.
SAMPLE_PER_CLASS = 3000
#: Bytes of one dictionary.
DICT_BYTES = 64 * 1024
#: A text is compressed in pieces of so many bytes, all of them: the dictionary then counts alike everywhere in it.
PIECE = 1024
#: The rows that a dictionary is made from have so many bytes together at most; each is learnt whole.
SAMPLE_BYTES = 6 << 20


def _pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class Model:
    """Two dictionaries and a logistic curve over the normalised difference of the compressed sizes."""

    def __init__(self, good: bytes, bad: bytes, slope: float, shift: float):
        self.good, self.bad, self.slope, self.shift = good, bad, slope, shift

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def _ready(self) -> None:
        if not hasattr(self, "_by"):
            options = {"level": 1, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._by = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **options) for d in (self.good, self.bad)]

    def difference(self, text: str | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / their sum; 0 for a text without bytes."""
        self._ready()
        good, bad = (sum(len(c.compress(p)) for p in _pieces(text)) for c in self._by)
        return (bad - good) / (bad + good) if good + bad else 0.0

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.shift, -30, 30)))


def _dictionary(pieces: list[bytes]) -> bytes:
    pieces = [p for p in pieces if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=1).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train from: the raw text is a dictionary of its own
        return b"".join(pieces)[-DICT_BYTES:] or b"        "


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve by Newton's method, with both classes weighing the same and his smoothed targets."""
    if len(x) == 0 or len(set(y)) < 2:
        return 0.0, float(np.clip(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), -5, 5)) if len(x) else 0.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t, w = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.where(y == 1, 0.5 / n1, 0.5 / n0)
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), a.T @ (w * (p - t)))
        b -= step
        if abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def held_out(doc_id):
    """The rows that no label is learnt from: crc32 of the id as text leaves 1 when divided by 3 (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most `per_class` labelled documents of each class that are not held out, on the whole of their texts.

    The rows are those whose hashed ids are smallest. Their ids, at most 2 * per_class, are broadcast to the scan of
    the documents, so that no text but theirs moves; labels that are neither 0 nor 1, null ids, and ids that have both labels
    are left out. Rows of even hash make the dictionaries: of each class as many, in the order of their hashes, as have
    most_bytes together, each whole (one that has more by itself isn't in the sample), are cut to pieces on the
    executors and come to the driver. The others set the curve: they are compressed on the executors, and a number for
    each comes back. So the driver's share is bounded, however long the texts.
    """
    rank = F.xxhash64("doc_id", "quality")
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    chosen = None
    for q in (0, 1):
        some = usable.where(F.col("quality") == q).withColumn("rank", rank).orderBy("rank", "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionAll(some)
    fold = F.pmod(F.floor(F.col("rank").cast("decimal(38,0)") / 7), F.lit(2)).cast("int").alias("fold")
    texts = store(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("rank", "doc_id", "quality", "text", fold), "labelled")

    @F.pandas_udf("array<binary>")
    def cut(series: pd.Series) -> pd.Series:
        return series.map(_pieces)

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    so_far = Window.partitionBy("quality").orderBy("rank", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # at most per_class rows of a class
    learnt = texts.where("fold = 0").withColumn("size", size).where(F.col("size") <= most_bytes).withColumn("sum", F.sum("size").over(so_far)).where(F.col("sum") <= most_bytes)
    learnt = learnt.select("rank", "doc_id", "quality", F.posexplode(cut("text")).alias("at", "piece")).orderBy("rank", "doc_id", "at", "piece").select("quality", "piece").collect()
    made = [_dictionary([bytes(r.piece) for r in learnt if r.quality == q]) for q in (1, 0)]
    model = Model(*made, 0.0, 0.0)
    tuned = differences(texts.where("fold = 1"), model).select("size_difference", "quality").orderBy("size_difference", "quality").toPandas()
    drop(texts)
    model.slope, model.shift = _logistic(tuned["size_difference"].to_numpy(), tuned["quality"].to_numpy())
    return model


def differences(docs: DataFrame, model: Model) -> DataFrame:
    """docs with size_difference; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def difference(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([shared.value.difference(x) for x in t], dtype="float64")

    return docs.withColumn("size_difference", difference("text"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with size_difference, score (0 to 1, higher: likelier good) and predicted (1 if score >= 0.5).

    Any text gets a score, null and empty ones that of a difference of 0. Columns of these names are replaced.
    """
    scored = differences(docs.drop("score", "predicted"), model)
    curve = 1 / (1 + F.exp(-(F.lit(float(model.slope)) * F.col("size_difference") + F.lit(float(model.shift)))))
    return scored.withColumn("score", curve).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
