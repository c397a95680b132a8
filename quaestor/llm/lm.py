"""Cross-entropy difference: how much better a model of target text predicts a document than one of all text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, words
from .minhash import mix, word_hashes

#: A chunk of documents is closed when it has so many words or rows; counts are dealt to a block for each so many characters.
CHUNK_WORDS, CHUNK_ROWS, BLOCK_CHARS = 500_000, 10_000, 2_000_000
#: A block that chunks send more keys than this, as one with a very common word does, is summed in parts of about so many.
PART_KEYS = 2_000_000
#: Blocks that a task of the shuffles serves, where this makes more tasks than the session's number of shuffle partitions.
BLOCKS_A_TASK = 32
#: Bits of the hash that names a word or a pair of words.
KEY_BITS = 48
#: How many tokens' worth the unigram model counts after a word.
PRIOR = 50.0
WORD, PAIR = 0, 1

CHUNKS = "chunk long, doc_ids array<long>, lengths array<int>, vocabulary binary, tokens binary, blocks array<long>, sends array<long>"
ASKED = "block long, chunk long, kind int, keys binary, background binary, target binary"
TOLD = "block long, part int, chunk long, kind int, keys binary, places binary, background binary, target binary, n_different long"
MERGED = "block long, part int, kind int, background binary, target binary, n_different long"
ANSWER = "block long, chunk long, kind int, background binary, target binary"


def tokens(text: str | None) -> np.ndarray:
    """A hash for each word of a whole text, A-Z in lower case."""
    return word_hashes([w.lower() for w in words(text)])


def keys(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """The names of words, or of pairs of words."""
    mixed = mix(first) if second is None else mix(mix(first) * np.uint64(0x9E3779B97F4A7C15) + second)
    return mixed >> np.uint64(64 - KEY_BITS)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane: planes of small numbers take next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def chunks(docs: DataFrame, blocks: int) -> DataFrame:
    """Documents in chunks: ids, numbers of words, the different words' hashes, each word's place among these.

    And how many different keys the chunk will send to which blocks.
    """

    def close(number: int, ids: list, texts: list[np.ndarray]) -> pd.DataFrame:
        vocabulary, places = np.unique(np.concatenate(texts), return_inverse=True)
        lengths = [len(t) for t in texts]
        one, two, *_ = _grams(vocabulary, places, lengths)
        to, sends = np.unique(block_of(np.concatenate([np.unique(one), np.unique(two)]), blocks), return_counts=True)
        row = (number, ids, lengths, _pack_sorted(vocabulary), _pack(places), to, sends)
        return pd.DataFrame([row], columns=["chunk", "doc_ids", "lengths", "vocabulary", "tokens", "blocks", "sends"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, n, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(tokens(text))
                n += len(texts[-1])
                if n >= CHUNK_WORDS or len(ids) == CHUNK_ROWS:
                    yield close(number, ids, texts)
                    number, n, ids, texts = number + 1, 0, [], []
        if ids:
            yield close(number, ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, CHUNKS)


def _grams(vocabulary: np.ndarray, places: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: its words' keys, its pairs' keys, the place of each pair's first word, and the document of each word."""
    own = vocabulary[places]
    document = np.repeat(np.arange(len(lengths)), lengths)
    first = np.flatnonzero(document[:-1] == document[1:])
    return keys(own), keys(own[first], own[first + 1]), first, document


def _stored_grams(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _grams(_unpack_sorted(row.vocabulary), _unpack(row.tokens).astype(np.int64), row.lengths)


def ids_of(ids: list) -> pd.Series:
    """Exact ids, with nulls (which pandas would turn into floats)."""
    return pd.Series([None if pd.isna(i) else int(i) for i in ids], dtype="Int64")


def _ask(blocks: int):
    """Each chunk's different keys, with how often all of its documents have them, and its target documents; a row for each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                one, two, first, document = _stored_grams(row)
                is_target = np.zeros(len(row.lengths), dtype=bool)
                if row.targets is not None:
                    is_target[np.asarray(row.targets, dtype=np.int64)] = True
                wanted = is_target[document]
                for kind, own, by in ((WORD, one, wanted), (PAIR, two, wanted[first])):
                    if not len(own):
                        continue
                    different, at = np.unique(own, return_inverse=True)
                    n, n_target = np.bincount(at, minlength=len(different)), np.bincount(at[by], minlength=len(different))
                    block = block_of(different, blocks)
                    starts = np.flatnonzero(np.diff(block, prepend=-1))
                    out = [(int(block[a]), row.chunk, kind, _pack_sorted(different[a:b]), _pack(n[a:b]), _pack(n_target[a:b])) for a, b in zip(starts, [*starts[1:], len(different)], strict=True)]
                    yield pd.DataFrame(out, columns=["block", "chunk", "kind", "keys", "background", "target"])

    return run


def block_of(own: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks are ranges of keys, so that keys in order are blocks in order. At most 2**32 blocks."""
    return (((own >> np.uint64(KEY_BITS - 32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def _summed(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The different keys of rows (keys, background, target), the places of each row's keys among them, and both sums."""
    asked = [_unpack_sorted(x) for x in rows["keys"]]
    different, at = np.unique(np.concatenate(asked), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([_unpack(x) for x in rows[c]]), minlength=len(different)).astype(np.uint64) for c in ("background", "target")]
    return different, np.split(at, np.cumsum([len(x) for x in asked])[:-1]), sums


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows under a schema's names, its whole numbers with exact nulls."""
    fields = [f.split() for f in schema.split(", ")]
    return pd.DataFrame(rows, columns=[n for n, _ in fields]).astype({n: "Int64" for n, t in fields if t != "binary"})


def _tell(group: pd.DataFrame) -> pd.DataFrame:
    """In a block: the sums over all chunks, for each chunk's keys; and a row without a chunk that counts the different words.

    In a part of a block: the part's keys and sums, without a chunk, and for each chunk the places of its keys among them.
    """
    block, part, whole, out = int(group["block"].iat[0]), int(group["part"].iat[0]), group["parts"].iat[0] == 1, []
    for kind, rows in group.groupby("kind"):
        different, places, (background, target) = _summed(rows)
        if whole:
            out += [(block, part, c, kind, None, None, _pack(background[p]), _pack(target[p]), None) for c, p in zip(rows["chunk"], places, strict=True)]
            if kind == WORD:
                out.append((block, part, None, kind, None, None, None, None, len(different)))
        else:
            out += [(block, part, c, kind, None, _pack_sorted(p.astype(np.uint64)), None, None, None) for c, p in zip(rows["chunk"], places, strict=True)]
            out.append((block, part, None, kind, _pack_sorted(different), None, _pack(background), _pack(target), None))
    return _frame(out, TOLD)


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Of a block's parts: the sums over all parts, for each part's keys; and a row without a part that counts the different words."""
    block, out = int(group["block"].iat[0]), []
    for kind, rows in group.groupby("kind"):
        different, places, (background, target) = _summed(rows)
        out += [(block, p, kind, _pack(background[at]), _pack(target[at]), None) for p, at in zip(rows["part"], places, strict=True)]
        if kind == WORD:
            out.append((block, None, kind, None, None, len(different)))
    return _frame(out, MERGED)


def _pass_on(places: pd.DataFrame, merged: pd.DataFrame) -> pd.DataFrame:
    """In a part of a block: the merged sums, for each chunk's keys."""
    out = []
    for kind, rows in places.groupby("kind"):
        one = merged[merged["kind"] == kind].iloc[0]
        background, target = _unpack(one["background"]), _unpack(one["target"])
        for block, chunk, packed in zip(rows["block"], rows["chunk"], rows["places"], strict=True):
            at = _unpack_sorted(packed).astype(np.int64)
            out.append((block, chunk, kind, _pack(background[at]), _pack(target[at])))
    return _frame(out, ANSWER)


def _bits(n: float, n_target: float, different: int):
    """Scores the documents of each chunk from the sums that its blocks told.

    n, n_target: words of all documents and of the target's; different: different words of all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                one, two, first, document = _stored_grams(row)
                told = sorted([] if row.told is None else row.told, key=lambda t: (t["kind"], t["block"]))
                lengths = np.asarray(row.lengths, dtype=np.int64)
                means = []
                for column, scale in (("target", 1.0), ("background", n_target / max(1.0, n))):
                    of = []
                    for kind, own in ((WORD, one), (PAIR, two)):
                        sums = [_unpack(t[column]) for t in told if t["kind"] == kind]
                        of.append(np.concatenate(sums)[np.unique(own, return_inverse=True)[1]] * scale if sums else np.zeros(0))
                    alone = (of[0] + 1) / (n_target + different)
                    p = alone.copy()
                    p[first + 1] = (np.minimum(of[1], of[0][first]) + PRIOR * alone[first + 1]) / (of[0][first] + PRIOR)
                    sums = np.bincount(document, weights=-np.log2(p), minlength=len(lengths))
                    means.append([s / k if k else None for s, k in zip(sums, lengths.tolist(), strict=True)])
                frame = pd.DataFrame({"doc_id": ids_of(row.doc_ids), "n_tokens": lengths})
                frame["target_bits"], frame["background_bits"] = (pd.Series(m, dtype="float64") for m in means)
                yield frame

    return run


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, target_bits, background_bits (means for a token), difference (target less background).

    The background's model is of all rows of docs, the target's of those whose doc_id is in target_ids. Both are bigram
    models over the words of docs, matched in vocabulary, order, smoothing and size:
    p(w | v) = (c(v, w) + PRIOR * p(w)) / (c(v) + PRIOR), with p(w) from counts and 1, and the background's counts scaled
    to the target's number of words. A document's own counts are in the models that it is scored by. The lower the
    difference, the more a document is like the target. Texts without words have nulls; rows without an id are
    background.

    Every different pair of words is counted, in a table that grows with the corpus and that no task or driver holds:
    chunks of documents send each of their different keys once, with its counts, to the key's block; the block adds up
    and answers each chunk. So a hot word costs a row's entry for each chunk, not for each occurrence. A block that is
    sent more than PART_KEYS is added up in parts, each of some of the chunks; the parts' sums are merged, where a word
    that every chunk has is an entry for each part, and go back to the parts and from these to the chunks. What the
    driver gets are four sums.
    """
    blocks = 1 + int((docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // BLOCK_CHARS)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // BLOCKS_A_TASK)
    whole = store(chunks(docs, blocks), "chunks")
    ids = target_ids.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    listed = whole.select("chunk", F.posexplode("doc_ids").alias("at", "_id"))
    targets = store(listed.join(ids.hint("merge"), "_id").groupBy("chunk").agg(F.collect_list("at").alias("targets")), "targets")
    sent = whole.select(F.explode(F.arrays_zip("blocks", "sends")).alias("to")).groupBy("to.blocks").agg(F.sum("to.sends").alias("n"))
    large = store(sent.where(F.col("n") > PART_KEYS).select(F.col("blocks").alias("block"), F.ceil(F.col("n") / PART_KEYS).cast("int").alias("parts")), "large")
    marked = whole.join(targets.hint("merge"), "chunk", "left")
    asked = marked.select("chunk", "lengths", "vocabulary", "tokens", "targets").mapInPandas(_ask(blocks), ASKED)
    asked = asked.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int"))
    told = store(asked.repartition(tasks, "block", "part").groupBy("block", "part").applyInPandas(_tell, TOLD), "told")
    merged = store(told.where("keys is not null").groupBy("block").applyInPandas(_merge, MERGED), "merged")
    parts = told.where("places is not null").groupBy("block", "part").cogroup(merged.where("part is not null").groupBy("block", "part"))
    answers = told.where("chunk is not null and places is null").select("block", "chunk", "kind", "background", "target").unionAll(parts.applyInPandas(_pass_on, ANSWER))
    total = lambda c: F.coalesce(F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))
    n = whole.agg(total("lengths")).first()[0]
    n_target = whole.select("chunk", "lengths").join(targets, "chunk").agg(total(F.transform("targets", lambda i: F.element_at("lengths", i + 1)))).first()[0]
    counted = told.where("n_different is not null").select("n_different").unionAll(merged.where("n_different is not null").select("n_different"))
    different = counted.agg(F.coalesce(F.sum("n_different"), F.lit(0))).first()[0]
    answers = answers.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("kind", "block", "background", "target")).alias("told"))
    rows = whole.join(answers.hint("merge"), "chunk", "left").select("doc_ids", "lengths", "vocabulary", "tokens", "told")
    scored = rows.mapInPandas(_bits(float(n), float(n_target), int(different)), "doc_id long, n_tokens long, target_bits double, background_bits double")
    return scored.withColumn("difference", F.col("target_bits") - F.col("background_bits"))
