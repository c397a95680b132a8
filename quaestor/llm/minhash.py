"""Near-duplicate documents: one-permutation min-hashing with optimal densification, bands, stars, exact confirmation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_parts, store, words

#: Bands of ROWS slots each. At a similarity of 0.8 two sets miss each other in all bands with probability 5e-7.
BANDS, ROWS = 48, 6
SLOTS = BANDS * ROWS
#: Hashes of words a worker keeps.
KEPT_WORDS = 100_000

_word_hash: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(own: list[bytes]) -> np.ndarray:
    if len(_word_hash) > KEPT_WORDS:
        _word_hash.clear()
    for w in set(own):
        if w not in _word_hash:
            _word_hash[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_word_hash.__getitem__, own), dtype=np.uint64, count=len(own))


#: A random number for each byte, an odd factor and its inverse, by which words are hashed as polynomials modulo 2^64.
_BYTE = np.random.default_rng(20240517).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = 0xD1342543DE82EF95
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_WHITE_BYTE = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Bytes of a text that are hashed at once, and a word more.
HASHED = 1 << 20


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the factor and of its inverse."""
    out = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        row = np.full(n, base, dtype=np.uint64)
        row[0] = 1
        out.append(np.cumprod(row))
    return tuple(out)


def text_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of a text (None: none), with A-Z as a-z if `lower`; words() parts it at the same characters.

    Sums of the bytes' numbers times powers give all words of a part at once: a word's sum, moved to power 0.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    raw = raw.lower() if lower else raw
    out, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(raw):
        end = _WHITE_BYTE.search(raw, at + HASHED)
        part = np.frombuffer(raw, dtype=np.uint8, count=(end.start() if end else len(raw)) - at, offset=at)
        at += len(part)
        solid = np.zeros(len(part) + 2, dtype=np.int8)
        solid[1:-1] = ~_WHITE[part]
        edges = np.flatnonzero(np.diff(solid))
        start, stop = edges[::2], edges[1::2]
        power, inverse = _powers(1 << max(12, (len(part)).bit_length()))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        out.append(mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64)))
    return np.concatenate(out)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of `size` words, given by their hashes; of all words if there are fewer; none without words."""
    n = len(h)
    size = min(size, n)
    if not n:
        return h
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i]
    return mix(out)


@lru_cache(maxsize=64)
def _targets(block: int) -> np.ndarray:
    """Attempts 256 * block and on: the slot that each slot would copy from, the same for all sets."""
    at = np.arange(block * 256 * SLOTS, (block + 1) * 256 * SLOTS, dtype=np.uint64)
    return (mix(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(SLOTS)).astype(np.int64).reshape(256, SLOTS)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS values of a sorted, non-empty set of hashes.

    The upper bits deal a hash to a slot, the smallest stands for it (the first, as they are sorted). An empty slot
    copies from a slot drawn by its own sequence of attempts, the first that isn't empty.
    """
    slot = (((hashes >> np.uint64(32)) * np.uint64(SLOTS)) >> np.uint64(32)).astype(np.int64)
    at, first = np.unique(slot, return_index=True)
    values, filled = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=bool)
    values[at], filled[at] = hashes[first], True
    empty, block, taken = np.flatnonzero(~filled), 0, 0
    out = values.copy()
    while len(empty):
        step = min(256 - taken, max(8, 3 * SLOTS // len(at)))
        source = _targets(block)[taken : taken + step, empty]
        hit = filled[source]
        when = hit.argmax(axis=0)
        found = hit.any(axis=0)
        out[empty[found]] = values[source[when[found], np.flatnonzero(found)]]
        empty, taken = empty[~found], taken + step
        if taken == 256:
            block, taken = block + 1, 0
    return out


def band_keys(slots: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in slots.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, slots binary"
#: Members of a bucket are compared in blocks of so many, a task holding two blocks; by slots they must agree in this
#: share to be confirmed on the full sets. At a similarity of 0.8 that is over four deviations below what is expected.
BLOCK, LIKELY = 2000, 0.7
#: Texts of a component, and texts to be compared with it, that a task holds.
PART = 250


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """For each row of docs (doc_id, text): the size of its set, a 128-bit digest of the set, the keys of its bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = np.unique(shingle_hashes(text_hashes(text, lower=True), shingle_words))
                if len(own):
                    twice = mix(own + np.uint64(0x2545F4914F6CDD1D))
                    slots = signature(own)
                    out.append((doc_id, len(own), own.sum().view(np.int64), twice.sum().view(np.int64), band_keys(slots), slots.astype(np.uint8).tobytes()))
                else:
                    out.append((doc_id, 0, 0, 0, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "d1", "d2", "bands", "slots"]).astype({"doc_id": "Int64"})

    return map_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SKETCH)


def _across(group: pd.DataFrame) -> pd.DataFrame:
    """In a pair of blocks of one bucket: (rep, component), where the rep's slots agree in LIKELY of all with some member of another component."""
    slots = np.frombuffer(b"".join(group["slots"]), dtype=np.uint8).reshape(len(group), SLOTS)
    rep, block, component = group["rep"].to_numpy(), group["block"].to_numpy(), group["component"].to_numpy()
    crossing = group["low"].iat[0] != group["high"].iat[0]
    number, part = np.unique(component, return_inverse=True)
    most = np.bincount(part, minlength=len(number)).argmax()
    found = set()
    for i in np.flatnonzero(part != most):
        others = (part != part[i]) & ((part == most) | (rep > rep[i]))
        if crossing:
            others &= block != block[i]
        j = np.flatnonzero(others)
        found |= {(int(rep[i]), int(c)) for c in np.unique(component[j[(slots[j] == slots[i]).mean(axis=1) >= LIKELY]])}
    return pd.DataFrame(sorted(found), columns=["rep", "component"]).astype("int64")


def unlinked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, component): a set and a component of others that it may be linked with, as buckets of `members` (key, rep, component) show.

    A bucket is dealt to pairs of blocks, so none is held by one task. Most members of a large bucket are in one
    component by now; only the others are compared, with all, and a task gives components, not pairs.
    """
    several = members.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least <> most AND n > 2")
    several = store(several.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "several")
    rows = members.join(several, "key").join(sets.select("rep", "slots"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return rows.select("key", "low", "high", "block", "rep", "component", "slots").groupBy("key", "low", "high").applyInPandas(_across, "rep long, component long").distinct()


def confirm_with_components(asked: DataFrame, members: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """For asked (rep, component) links (a, b) of the rep with members of the component, counted on the full sets; one from each task.

    Both sides of a component are dealt to parts of about PART texts, and each pair of parts is a task.
    """
    whole = members.select("rep", "component").distinct().join(asked.select("component").distinct(), "component")
    parts = whole.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("rights")).join(asked.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("lefts")), "component")
    parts = store(parts, "parts")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, "component").select("component", "rep", F.lit(True).alias("asks"), deal("lefts").alias("left"), every("rights").alias("right"))
    right = whole.join(parts, "component").select("component", "rep", F.lit(False).alias("asks"), every("lefts").alias("left"), deal("rights").alias("right"))
    rows = left.unionByName(right).join(texts.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep"), "rep")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ours = [(r, _set(t, shingle_words)) for r, t in zip(group["rep"], group["text"], strict=True)]
        asks = group["asks"].to_numpy()
        theirs = [ours[i] for i in np.flatnonzero(~asks)]
        out = []
        for i in np.flatnonzero(asks):
            a, x = ours[i]
            for b, y in theirs:
                least, most = sorted((len(x), len(y)))
                if 100 * least >= percent * most and 100 * (both := len(x & y)) >= percent * (least + most - both) and both:
                    out.append((a, b))
                    break
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.groupBy("component", "left", "right").applyInPandas(compare, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union, counted on the full sets of shingles."""

    @F.pandas_udf("boolean")
    def alike(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last: tuple = (None, None)
        for left, right in series:
            out = []
            for x, y in zip(left, right, strict=True):
                if last[0] != x:
                    last = x, _set(x, shingle_words)
                a, b = last[1], _set(y, shingle_words)
                both = len(a & b)
                out.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pd.Series(out, dtype="bool")

    left = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    return pairs.hint("merge").join(left, "b").hint("merge").join(right, "a").where(alike("text_a", "text_b")).select("a", "b").distinct()


def _set(text: str, size: int) -> set:
    own = [w.lower() for w in words(text)]
    return set(zip(*(own[i:] for i in range(size)), strict=False)) if len(own) >= size else {tuple(own)} if own else set()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept.

    A document's set has its different shingles of `shingle_words` words (A-Z in lower case); a shorter text is one
    shingle, a null or empty one has none and is linked with nothing. Two documents are linked if 100 * intersection
    >= percent * union. component_id is the smallest doc_id that links reach, kept says that it is the row's own.
    Rows of one doc_id give equal rows: where their sets differ, the greatest text is the document's. One with a null id
    is a component of its own with a null component_id and is kept. Columns other than doc_id and text don't matter.

    Equal sets first become one, by digest, so groups of copies cost a row each from there on. In each bucket the
    member whose hash with the bucket is smallest is the centre, and the others make a pair with it: as many pairs
    as rows, whatever a bucket's size, with another centre in another band. Pairs are confirmed on the full sets.
    Members of a bucket that are then still in different components are compared by their slots, in blocks; where
    these agree enough, the one is compared on full sets with all of the other's component, in parts. So no link
    between members of a bucket is lost, and no group's pairs are written out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = store(sketches(docs, shingle_words), "sketches")
    digest = F.struct("n_shingles", "d1", "d2")
    several = store(s.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most").select("doc_id"), "several")
    greatest = store(docs.join(several, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "greatest")
    named = store(sketches(greatest, shingle_words).select("doc_id", digest.alias("named")), "named")
    s = s.join(named, "doc_id", "left").withColumn("digest", F.coalesce("named", digest))
    sets = s.where(digest == F.col("digest")).where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("slots").alias("slots"))
    sets = store(sets, "sets")
    buckets = sets.select("rep", F.explode("bands").alias("key"))
    centres = store(buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key"), "rep"))["rep"].alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n"), "centres")  # a table of its own: then the join's hot keys can be split
    star = store(buckets.join(centres, "key"), "stars")
    pairs = store(star.where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    single = docs.join(several, "doc_id", "left_anti").unionAll(greatest)
    texts = store(single.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    links = store(confirm(pairs, texts, shingle_words, percent), "links")
    component = store(connected_components(links), "components")
    members = star.join(component, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component_id", "rep").alias("component"))
    members = store(members, "members")
    asked = store(unlinked(members, sets), "asked")
    more = store(confirm_with_components(asked, members, texts, shingle_words, percent), "links")
    component = store(connected_components(links.unionAll(more)), "components")
    rep = sets.join(component, F.col("rep") == F.col("id"), "left").select("d1", "d2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    out = s.select("doc_id", "digest.*").join(rep, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
