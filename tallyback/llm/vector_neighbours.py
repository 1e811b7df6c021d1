"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

* A rotation is learned on a bounded sample so that the signs of the rotated principal components are balanced
  and close to the components themselves; every vector becomes 64 bits. Further rotations, each learned from a
  start of its own, add 64 bits each where a label is large.
* The bits are cut into blocks. Vectors that agree in a block share a bucket of that table. Blocks grow with the
  logarithm of the label's own size, and with them grows the number of tables, so that a pair just at the threshold
  meets with a chance of RECALL or more in labels of any size.
* In a bucket all pairs are rescored with the original vectors in double precision. Only one row per vector
  leaves a bucket: how many links it has there and the smallest vector it is connected to. A
  pair is counted only in the first bucket it shares, which its codes tell.

Equal vectors are one entry with a weight. A bucket of more than ``BLOCK`` entries is cut into chunks, and
pairs of chunks go to different tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import components, cut_lineage, release
from tallyback.llm.families import whole_groups
from tallyback.llm.text import U64, signed

FIT_SAMPLE = 10_000  # vectors the rotation is learned on, about; every vector is indexed
BITS = 64
BLOCK = 512  # entries of a bucket that are compared in one task
FULL_BLOCK = 8  # bits of a block while a label has no more than 2**14 vectors
PER_KEY = 64  # vectors of a label that share a key by chance, about
RECALL = 0.97  # least chance that a pair at a cosine of 0.93 meets in a table
UNLIKE = np.arccos(0.93) / np.pi  # chance that such a pair differs in a bit


def learn_rotation(vectors: np.ndarray, rounds: int = 50, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x BITS) whose signs are the code of a unit vector."""
    dim = vectors.shape[1]
    rng = np.random.default_rng(seed)
    mean = vectors.mean(0) if len(vectors) else np.zeros(dim)
    own = min(BITS, dim)
    if len(vectors) > dim:
        _, axes = np.linalg.eigh(np.cov((vectors - mean).T).reshape(dim, dim))
        base = axes[:, ::-1][:, :own]
    else:
        base = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :own]
    rotation = np.linalg.qr(rng.normal(size=(own, own)))[0]
    seen = (vectors - mean) @ base
    for _ in range(rounds if len(vectors) else 0):
        signs = np.where(seen @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ seen)
        rotation = (u @ v).T
    extra = rng.normal(size=(dim, BITS - own))  # fewer dimensions than bits: random directions fill up
    return mean, np.concatenate([base @ rotation, extra], axis=1)


Model = tuple[np.ndarray, np.ndarray]


def learn_rotations(vectors: np.ndarray, words: int) -> list[Model]:
    """One rotation for each 64 bits of a code."""
    return [learn_rotation(vectors, seed=3 + word) for word in range(words)]


def codes_of(vectors: np.ndarray, models: list[Model]) -> np.ndarray:
    """Codes, one column of 64 bits per rotation."""
    words = [np.packbits((vectors - mean) @ axes >= 0, axis=1).view(">u8").astype(U64).ravel() for mean, axes in models]
    return np.stack(words, axis=1)


def table_masks(largest: int) -> list[int]:
    """Bits that make the key of each table, for a label of up to ``largest`` vectors; 64 bits of a code per rotation.

    Keys are so long that a bucket holds about PER_KEY vectors by chance, and so many that a pair at the threshold
    agrees in one of them with a chance of RECALL.
    """
    width = min(max(FULL_BLOCK, int(np.ceil(np.log2(max(largest, 1) / PER_KEY)))), BITS)
    tables = int(np.ceil(np.log(1 - RECALL) / np.log1p(-((1 - UNLIKE) ** width))))
    per_word = BITS // width
    return [((1 << width) - 1) << (BITS * (i // per_word) + width * (i % per_word)) for i in range(tables)]


def _placed(masks: list[int]) -> list[tuple[int, np.uint64]]:
    """The column of a code that each mask reads, and its bits there."""
    words = [(mask.bit_length() - 1) // BITS for mask in masks]
    return [(word, U64(mask >> (BITS * word))) for word, mask in zip(words, masks)]


class Tables:
    """The tables of every label, by its size; only labels beyond 2**14 vectors are listed one by one."""

    def __init__(self, large: dict[int, int]):
        smallest = PER_KEY << FULL_BLOCK
        self._level = {label: int(size - 1).bit_length() for label, size in large.items()}
        self._keys = {level: _placed(table_masks(1 << level)) for level in set(self._level.values())}
        self._keys[0] = _placed(table_masks(smallest))
        self.words = max(self.words_of(level) for level in self._keys)

    def level(self, label: int) -> int:
        return self._level.get(label, 0)

    def keys(self, level: int) -> list[tuple[int, np.uint64]]:
        return self._keys[level]

    def words_of(self, level: int) -> int:
        return 1 + max(word for word, _ in self._keys[level])


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    v = np.array(rows, float)
    size = np.sqrt((v * v).sum(1))
    return v / size[:, None], size


def _entries(models: dict[int, list[Model]], tables: Tables):
    def run(batches):
        for batch in batches:
            ids, label, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vectors = batch.column(3)
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
            levels = np.array([tables.level(x) for x in label.tolist()], np.int64)
            for dim, level in sorted(set(zip(dims.tolist(), levels.tolist()))):
                at = np.flatnonzero((dims == dim) & (levels == level))
                some = vectors.take(pa.array(at))
                unit, _ = _unit(some.flatten().to_numpy().reshape(len(at), dim))
                if dim not in models:
                    models[dim] = learn_rotations(np.zeros((0, dim)), tables.words)
                codes = codes_of(unit, models[dim][: tables.words_of(level)])
                packed = pa.array([code.tobytes() for code in codes], pa.binary())
                for table, (word, mask) in enumerate(tables.keys(level)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), dim, np.int32)), pa.array(label[at]), pa.array(np.full(len(at), table, np.int32)),
                         pa.array(signed(codes[:, word] & mask)), pa.array(ids[at]), pa.array(copies[at]), packed, some],
                        ["dim", "label", "tab", "key", "vec_id", "copies", "code", "vector"],
                    )

    return run


def _connected(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each, over a symmetric matrix of links."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _rescore(cosine: float, tables: Tables):
    def bucket(earlier: list[tuple[int, np.uint64]], side: np.ndarray, ids, copies, packed: pa.Array, unit):
        links = unit @ unit.T >= cosine
        np.fill_diagonal(links, False)
        if (side != side[0]).any():
            links &= side[:, None] != side[None, :]
        a, b = np.nonzero(links)
        counts = np.zeros(len(ids), np.int64)
        if len(a):
            codes = np.frombuffer(b"".join(packed.to_pylist()), U64).reshape(len(ids), -1)
            first = np.ones(len(a), bool)
            for word, mask in earlier:
                first &= ((codes[a, word] ^ codes[b, word]) & mask) != 0
            np.add.at(counts, a[first], copies[b[first]])
        order = np.argsort(ids, kind="stable")  # roots by smallest id
        root = np.empty(len(ids), np.int64)
        root[order] = ids[order][_connected(links[np.ix_(order, order)])]
        some = links.any(axis=1)
        return ids[some], counts[some], root[some]

    def run(batches):
        for rows in whole_groups(batches, rows=4000):
            rows = rows.combine_chunks()
            col = {name: rows.column(name).combine_chunks() for name in rows.column_names}
            key = [col[k].to_numpy(zero_copy_only=False) for k in ("g", "dim", "label", "tab", "key", "c1", "c2")]
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
            cuts = np.append(np.flatnonzero(new), rows.num_rows)
            ids, copies, chunk = (col[k].to_numpy(zero_copy_only=False) for k in ("vec_id", "copies", "chunk"))
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2:
                    continue
                # A pair of chunks of which one is empty here has nothing to compare that its own block does not.
                if key[5][lo] != key[6][lo] and (chunk[lo:hi] == chunk[lo]).all():
                    continue
                unit, _ = _unit(col["vector"].slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, key[1][lo]))
                earlier = tables.keys(tables.level(int(key[2][lo])))[: int(key[3][lo])]
                found.append(bucket(earlier, chunk[lo:hi], ids[lo:hi], copies[lo:hi], col["code"].slice(lo, hi - lo), unit))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["vec_id", "links", "root"])

    return run


def near_duplicate_vectors(
    table: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Link vectors of one label whose cosine is ``cosine`` or more: vec_id, n_links, component_id, kept.

    n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable by links (itself
    included), kept marks the smallest. No pair below the cosine is linked; the index may miss a pair (about 3 %
    of those exactly at 0.93, fewer above, whatever the size of the label). Vectors that are null, empty, zero or hold null or non-finite
    numbers, and those without label, link with nothing, nor do vectors of unequal length. Equal vectors link with each other.
    Rows that share a vec_id are one vector, the smallest by (label, vector scaled to its largest number), and all get its result; a null id
    links with nothing and has a null component. An empty table gives an empty result.
    """
    rows = table.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
    )
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", number)
    sound &= F.exists("vector", lambda x: x != 0)
    usable = rows.filter(F.coalesce(sound, F.lit(False)))
    # Scaling by the largest number keeps squares finite; the cosine does not change.
    peak = F.array_max(F.transform("vector", F.abs))
    scaled = usable.select("vec_id", "label", F.transform("vector", lambda x: x / peak).alias("scaled"))
    one = scaled.groupBy("vec_id").agg(F.min(F.struct("label", "scaled")).alias("row"))
    usable = cut_lineage(one.select("vec_id", "row.label", "row.scaled"))
    merged = cut_lineage(usable.groupBy("label", "scaled").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    entries = merged.select(F.col("rep").alias("vec_id"), "label", "copies", F.col("scaled").alias("vector"))

    total = entries.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample: dict[int, list] = {}
    for row in entries.filter(draw < FIT_SAMPLE / max(total, 1)).orderBy("vec_id").select("vector").toLocalIterator():
        sample.setdefault(len(row.vector), []).append(row.vector)
    # One row per label of more than 2**14 vectors: a small share of a small share of the input.
    large = entries.groupBy("label").count().filter(F.col("count") > PER_KEY << FULL_BLOCK)
    tables = Tables({row["label"]: row["count"] for row in large.toLocalIterator()})
    models = {dim: learn_rotations(_unit(found)[0], tables.words) for dim, found in sample.items()}

    keys = ["dim", "label", "tab", "key"]
    indexed = entries.mapInArrow(
        _entries(models, tables),
        "dim int, label long, tab int, key long, vec_id long, copies long, code binary, vector array<double>",
    )
    sizes = indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    chunked = indexed.join(sizes, keys).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    dealt = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *keys, "vec_id", "copies", "code", "vector", "chunk", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2")
    )
    group = [*keys, "c1", "c2"]
    dealt = dealt.withColumn("g", F.xxhash64(*group)).select("g", *group, "vec_id", "copies", "code", "vector", "chunk")
    scored = cut_lineage(
        dealt.repartition("g").sortWithinPartitions("g", *group).mapInArrow(_rescore(cosine, tables), "vec_id long, links long, root long")
    )
    links = scored.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    comp = components(scored.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")

    member = usable.select("vec_id", "label", "scaled").join(merged, ["label", "scaled"]).select(F.col("vec_id").alias("id"), "rep", "copies")
    known = member.join(links, "rep", "left").join(comp, "rep", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.select("vec_id").join(known, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
