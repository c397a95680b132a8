"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, store

#: Tables, hashes joined in a table's key, and buckets of a table that a vector is put into: its own and the next likely.
#: Two vectors of 64 components at a cosine of 0.98 share no bucket with probability 2e-6.
TABLES, HASHES, PROBES = 6, 3, 4
SEED = 20240229
#: A bucket is compared in blocks of so many vectors, two at a time; buckets of up to SMALL rows many at once.
BLOCK, SMALL = 1000, 64
#: Pairs whose vectors are held at once.
PAIRS = 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each column (of a power of two), scaled to keep lengths."""
    d, n = x.shape
    width = 1
    while width < d:
        halves = x.reshape(d // (2 * width), 2, width, n)
        x = np.stack([halves[:, 0] + halves[:, 1], halves[:, 0] - halves[:, 1]], axis=1).reshape(d, n)
        width *= 2
    return x * x.dtype.type(1 / np.sqrt(d))


def keys(vectors: np.ndarray, seed: int = SEED) -> np.ndarray:
    """For each unit vector (row) its PROBES bucket keys in each of TABLES tables, as (row, table, probe).

    A hash is the nearest of the 2d points +-e_i after three rounds of random signs and a Hadamard transform. A table
    joins HASHES of them. Probing swaps in second nearest points where that loses least.
    """
    n, d = vectors.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((wide, n), dtype=np.float32)
    padded[:d] = vectors.T
    draw, column = np.random.default_rng(seed), np.arange(n)
    out = np.empty((n, TABLES, PROBES), dtype=np.int64)
    for table in range(TABLES):
        points, losses = [], []
        for _ in range(HASHES):
            x = padded
            for _ in range(3):
                x = hadamard(x * draw.choice((-1.0, 1.0), (wide, 1)).astype(np.float32))
            size = np.abs(x)
            first = size.argmax(axis=0)
            most = size[first, column]
            size[first, column] = -1
            second = size.argmax(axis=0)
            losses.append(most - size[second, column])
            points.append([2 * at + (x[at, column] < 0) for at in (first, second)])
        swaps = [[i >> h & 1 for h in range(HASHES)] for i in range(1 << HASHES)]
        cost = np.stack([sum((loss for swap, loss in zip(own, losses, strict=True) if swap), np.zeros(n)) for own in swaps])
        key = np.stack([sum(p[swap] * (2 * wide) ** h for h, (swap, p) in enumerate(zip(own, points, strict=True))) for own in swaps])
        out[:, table] = np.take_along_axis(key, np.argsort(cost, axis=0, kind="stable")[:PROBES], axis=0).T
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length of vectors in a column without nulls."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().to_numpy())
    lengths = np.diff(ends, prepend=0)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[(ends[rows] - length)[:, None] + np.arange(length)]


def hashed(sets: DataFrame) -> DataFrame:
    """sets (rep, label, weight, vector) with `buckets`: the keys of TABLES tables, PROBES each."""
    kind = dict(sets.dtypes)["vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((len(batch), TABLES * PROBES), dtype=np.int64)
            for rows, x in _by_length(batch.column("vector")):
                out[rows] = keys(_unit(x)).reshape(len(rows), -1)
            ends = pa.array(np.arange(0, out.size + 1, TABLES * PROBES), type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["rep", "label", "weight", "vector", "buckets"])

    return sets.select("rep", "label", "weight", "vector").mapInArrow(run, f"rep long, label string, weight long, vector {kind}, buckets array<long>")


def _blocks(sets: DataFrame) -> DataFrame:
    """Rows to compare: each bucket's members, dealt to blocks by hash, and each member to all pairs of blocks with its own.

    Only ids meet to find the buckets of two or more; vectors go to those alone, and no bucket is ever whole. A
    bucket's name is a hash of its label, the vectors' length, the table and the key.
    """
    named = F.transform("buckets", lambda key, at: F.xxhash64("label", F.size("vector"), F.floor(at / PROBES), key))
    sets = store(sets.withColumn("buckets", named), "hashed")
    table = sets.select("rep", F.posexplode("buckets").alias("at", "bucket")).select("rep", F.floor(F.col("at") / PROBES).cast("int").alias("slot"), "bucket")
    sized = table.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sized = store(sized, "buckets")  # a table of its own: then the join's hot keys can be split
    own = table.join(sized, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return own.select("bucket", "low", "high", "slot", "block", "rep").join(sets, "rep")


def _close(x: np.ndarray, group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows, a < b, of one group (rows of a group are neighbours) with an inner product of `least` or more."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(starts, append=len(group))
    found = [np.zeros((2, 0), dtype=np.int64)]
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        a = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        for part in np.split(a, range(PAIRS, len(a), PAIRS)):
            found.append(np.stack([part, part + step])[:, np.einsum("ij,ij->i", x[part], x[part + step]) >= least])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        rows = x[start : start + size]
        found.append(start + np.stack(np.nonzero(np.triu(rows @ rows.T >= least, 1))))
    return tuple(np.concatenate(found, axis=1))


def _first_common(a: np.ndarray, b: np.ndarray, codes: np.ndarray, slot: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which pairs meet in their group's bucket first: in no table before, and there in no bucket of a smaller name."""
    mine = np.ones(len(a), dtype=bool)
    for low in range(0, len(a), PAIRS):
        i, j = a[low : low + PAIRS], b[low : low + PAIRS]
        left = np.arange(len(i))
        for table in range(TABLES):
            x, y = codes[i[left], table], codes[j[left], table]
            same = (x[:, :, None] == y[:, None, :]).any(axis=2)
            here = slot[i[left]] == table
            best = np.where(same, x, np.iinfo(np.int64).max).min(axis=1) == bucket[i[left]]
            mine[low + left[(here & ~best) | (~here & same.any(axis=1))]] = False
            left = left[~here & ~same.any(axis=1)]
            if not len(left):
                break
    return mine


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest one that the pairs connect it with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        lower = np.minimum(root[a], root[b])
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, lower)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(least: float):
    """Reads rows in order of their groups (a bucket's pair of blocks); gives how much weight each vector is linked with, and edges that span what is linked.

    Groups are read whole, as many as a batch has at a time; the last one waits for the next batch.
    """
    number = lambda batch, name: batch.column(name).to_numpy(zero_copy_only=False)

    def links(table: pa.Table) -> pa.RecordBatch:
        rep, weight, slot, block, bucket, low, high = (number(table, c) for c in ("rep", "weight", "slot", "block", "bucket", "low", "high"))
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        own = np.zeros(len(rep), dtype=np.int64)
        own[1:] = np.cumsum((np.diff(bucket) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0))
        codes = table.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(rep), TABLES, PROBES)
        found = []
        for rows, x in _by_length(table.column("vector").combine_chunks()):
            a, b = (rows[i] for i in _close(_unit(x), own[rows], least))
            pick = (label[a] == label[b]) & (rep[a] != rep[b]) & ((low[a] == high[a]) | (block[a] != block[b]))
            found.append((a[pick], b[pick]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        mine = _first_common(a, b, codes, slot, bucket)
        a, b = a[mine], b[mine]
        linked = np.bincount(a, weight[b], len(rep)) + np.bincount(b, weight[a], len(rep))
        some = np.flatnonzero(linked)
        to = rep[_roots(len(rep), a, b)[some]] if len(some) else rep[some]
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(linked[some].astype(np.int64)), pa.array(to)], names=["rep", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            ends = tuple(np.concatenate([number(b, c)[[0, -1]] for b in (held[0], held[-1])])[[0, 3]] for c in ("bucket", "low", "high"))
            if all(first == last for first, last in ends):
                continue
            last = np.ones(len(batch), dtype=bool)
            for c, (_, value) in zip(("bucket", "low", "high"), ends, strict=True):
                last &= number(batch, c) == value
            cut = len(batch) - int(last.sum())
            if cut or len(held) > 1:
                yield links(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each row of vectors: vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null, they have as many components, and their cosine in
    double precision is `least` or more. A vector that is null, empty, zero or holds a null or a number that isn't finite
    is linked with nothing. component_id is the smallest vec_id that links reach; rows with a null id have a null one
    and are kept. Columns other than the three don't matter.

    Equal vectors of a label first become one with their number as its weight. Buckets are compared in pairs of
    blocks of about BLOCK vectors at most, and give a count for each vector and edges that span what is linked, not
    the pairs. A pair that meets in several buckets counts in the first. What no bucket shows is lost: see TABLES.
    """
    kind = "double" if dict(vectors.dtypes)[vector] == "array<double>" else "float"
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"), F.col(label).cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    v = v.withColumn("usable", usable).withColumn("vector", F.when(F.col("usable"), F.transform("vector", lambda x: x + F.lit(0.0).cast(kind))))
    good = v.where("usable").select("vec_id", "label", "vector", F.xxhash64("vector").alias("d1"), F.xxhash64(F.lit(1), "vector").alias("d2"))
    same = good.groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("vector").alias("vector"))
    same = store(same, "vectors")
    order = ["bucket", "low", "high"]
    rows = _blocks(hashed(same)).repartition(*order).sortWithinPartitions(*order)
    found = store(rows.mapInArrow(_compare(least), "rep long, links long, to long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = store(connected_components(found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b"))), "components")
    by_set = same.select("label", "d1", "d2", "rep", "weight").join(counts, "rep", "left").join(component, F.col("rep") == F.col("id"), "left")
    by_set = by_set.select("label", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = good.select("vec_id", "label", "d1", "d2").join(by_set, ["label", "d1", "d2"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
