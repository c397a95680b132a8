"""Quality rules by tokeniser fertility: how public vocabularies cut a text tells ordinary prose from noise."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, words

SYMBOLS = "#*$%&|<>"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

#: Widest bands by script: lowest and highest characters per token (byte-level vocabulary), highest share of
#: byte-fallback tokens (piece vocabulary). `other` is for texts without letters of these scripts.
BANDS = {
    "latin": (1.2, 7.0, 0.10),
    "greek": (0.6, 4.5, 0.20),
    "cyrillic": (0.8, 6.5, 0.10),
    "hebrew": (0.4, 4.5, 0.20),
    "arabic": (0.4, 5.0, 0.20),
    "indic": (0.2, 4.0, 0.80),
    "cjk": (0.25, 3.0, 0.80),
    "other": (0.4, 5.0, 0.50),
}
#: A language's own band reaches so many median absolute deviations to either side of its median (for texts of
#: STEADY words and more; shorter texts scatter, by the root of their length), and at least so many shares of it.
DEVIATIONS, STEADY, LEAST_SHARE = 8.0, 200, 0.08
#: A language's figures weigh by its number of texts against those of the script with this weight; a script's likewise
#: against the middle of its widest band and the deviation that fills it.
PRIOR_TEXTS = 50
#: The lowest token entropy in bits; texts of under STEADY tokens, which can't have as much, are held to a share by the
#: logarithm of their length.
LEAST_ENTROPY = 3.0

#: First and last code points of ranges that count as a script's letters.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "indic": [(0x900, 0xDFF)],
    "cjk": [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)],
}
_RANGES = sorted((low, high + 1, i) for i, ranges in enumerate(SCRIPTS.values()) for low, high in ranges)
_EDGES = np.array([x for low, high, _ in _RANGES for x in (low, high)], dtype=np.uint32)
#: The script between two edges; the last number stands for none.
_BETWEEN = np.array([len(SCRIPTS)] + [x for _, _, i in _RANGES for x in (i, len(SCRIPTS))])


def script(text: str) -> str:
    """The script of most letters of a text, `other` if it has none; ties go to the one named first."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(_BETWEEN[np.searchsorted(_EDGES, points, side="right")], minlength=len(SCRIPTS) + 1)[:-1]
    return list(SCRIPTS)[int(counts.argmax())] if counts.any() else "other"


class Meter:
    """Measures texts by a SentencePiece vocabulary with byte fallback and by a byte-level one."""

    def __init__(self, piece_path: str, rank_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.is_byte = np.array([self.pieces.IsByte(i) for i in range(self.pieces.GetPieceSize())])
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def measure(self, text: str | None) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, script, chars_per_token, byte_share, token_entropy, n_pieces.

        Both vocabularies read the words joined by single spaces.
        """
        text = text or ""
        own = words(text)
        chars = len(text) - sum(map(text.count, WHITE))
        base = len(own), chars, sum(map(text.count, SYMBOLS)), _repeated_lines(text), _repeated_words(own), script(text)
        if not own:
            return (*base, None, None, None, 0)
        plain = b" ".join(own).decode("utf-8", "replace")
        ids = np.array(self.pieces.encode(plain, num_threads=1), dtype=np.int64)
        counts = np.unique(ids, return_counts=True)[1]
        share = counts / max(1, len(ids))
        entropy = float(-(share * np.log2(share)).sum()) + 0.0
        return (*base, chars / max(1, len(self.bytes_bpe.encode_ordinary(plain))), float(self.is_byte[ids].mean()) if len(ids) else 0.0, entropy, len(ids))


def _repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def _repeated_words(own: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of 5 words found twice or more in the text."""
    n = len(own)
    if n <= size:
        return 0
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in own], dtype=np.int64)
    two = np.unique(a[:-1] * len(number) + a[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    _, place, times = np.unique(four[:-1] * len(number) + a[4:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[place] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_meters: dict[tuple, Meter] = {}


def _meter(*paths: str) -> Meter:
    if paths not in _meters:
        _meters[paths] = Meter(*paths)
    return _meters[paths]


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, chars_per_token double, byte_share double, token_entropy double, n_pieces long"


def measure(docs: DataFrame, piece_path: str, rank_path: str, pattern: str) -> DataFrame:
    """docs with a struct column `measures`; a text without words has nulls for what tokens would tell."""

    @F.pandas_udf(MEASURES)
    def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        meter = _meter(piece_path, rank_path, pattern)
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for t in texts:
            yield pd.DataFrame([meter.measure(x) for x in t], columns=names)

    return docs.withColumn("measures", measures("text"))


def judge(docs: DataFrame, piece_path: str, rank_path: str, pattern: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each of docs: doc_id, the measures, script, base_failed, fertility_failed, kept.

    Base: fewer than 10 words, or over a fifth of the words in repeated windows. Fertility: outside the widest band of
    the script, outside the band that all texts of the language set by median and deviation of characters per
    token (short texts by their deviation scaled to STEADY words), or of too low an entropy for its length. The fewer texts a
    language has, the more its band leans to the script's. A null language has a band like any other. kept is false if
    either fails; null and empty texts fail the base. Measures are taken once, into a stored table, and languages counted
    from there.
    """
    read = measure(docs.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text")), piece_path, rank_path, pattern)
    m = store(read.select("doc_id", "lang", "measures.*"), "fertility")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = _with_middle(_with_middle(m, m, "script"), m, "lang")
    low, high, most_bytes = (_of_script(i) for i in range(3))
    median, deviation = (low + high) / 2, (high - low) / (2 * DEVIATIONS)
    for key in ("script", "lang"):
        n = F.coalesce(f"{key}_texts", F.lit(0))
        median, deviation = ((F.coalesce(n * F.col(f"{key}_{name}"), F.lit(0.0)) + PRIOR_TEXTS * prior) / (n + PRIOR_TEXTS) for name, prior in (("median", median), ("deviation", deviation)))
    width = F.greatest(DEVIATIONS * deviation, LEAST_SHARE * median) * _shaky()
    off = F.abs(F.col("chars_per_token") - median) > width
    least = LEAST_ENTROPY * F.least(F.lit(1.0), F.log2(F.greatest("n_pieces", F.lit(1)).cast("double")) / F.log2(F.lit(float(STEADY))))
    wild = (F.col("chars_per_token") < low) | (F.col("chars_per_token") > high) | (F.col("byte_share") > most_bytes) | (F.col("token_entropy") < least)
    out = out.withColumn("base_failed", base).withColumn("fertility_failed", F.coalesce(wild | off, F.lit(True)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("fertility_failed")).drop("n_pieces", *(f"{key}_{name}" for key in ("script", "lang") for name in ("median", "texts", "deviation")))


def _shaky() -> Column:
    """How much wider a text of few words scatters than one of STEADY words."""
    return F.sqrt(F.greatest(F.lit(1.0), F.lit(float(STEADY)) / F.greatest(F.col("n_words"), F.lit(1))))


def _with_middle(out: DataFrame, m: DataFrame, key: str) -> DataFrame:
    """Adds the median of characters per token over all texts of the same key, their number, and the median deviation."""
    median, texts, deviation = (f"{key}_{name}" for name in ("median", "texts", "deviation"))
    told = m.where("chars_per_token is not null").select(key, "chars_per_token", "n_words")
    middle = told.groupBy(key).agg(F.percentile_approx("chars_per_token", 0.5, 10_000).alias(median), F.count("*").alias(texts))
    same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    far = F.abs(F.col("chars_per_token") - F.col(median)) / _shaky()
    spread = told.alias("a").join(middle.alias("b"), same).groupBy(f"b.{key}", median, texts).agg(F.percentile_approx(far, 0.5, 10_000).alias(deviation))
    spread = store(spread, "middles")  # a row for each key: Spark broadcasts it if its measured size allows
    return out.alias("a").join(spread.alias("b"), same, "left").select("a.*", median, texts, deviation)


def _of_script(i: int) -> Column:
    return F.create_map(*(F.lit(x) for name, band in BANDS.items() for x in (name, float(band[i]))))[F.col("script")]
