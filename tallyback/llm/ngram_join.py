"""Similarity join of word n-gram sets over a distributed prefix tree.

A document's set of n-grams in a global hash order is a path in a tree; its ``HEAD`` first n-grams take part
here. Subtrees are dealt out by n-gram: a node holds the sets that have an n-gram in their prefix, where a prefix
takes the rarest n-grams of a head first (n-grams of no other head cost nothing, very common ones come last and
mostly fall out). In a node's task the heads are stored in a trie and every set is traversed against it:
sets with the same beginning share the overlap counted so far, and a subtree is left as soon as what remains
of it or of the set can't reach the overlap that is needed (remaining-length bound). A pair is followed only in the
node of its first common n-gram; all others leave it at their first step. N-grams that only sets of one
component have are left out of the lists first, and so are sets with too few others.

* Equal sets are one class throughout. First every set is joined with the most typical set of its nodes, which
  connects groups of near copies by stars instead of pairs; nodes whose sets are then all of one
  component are cut off, and pairs within a component are never formed.
* A node of more than ``crowd`` sets is cut into chunks; pairs of chunks go to different tasks, save those within its largest component.
* A parity signature (an upper bound of the overlap) tells beforehand which sets of a node a set can match at all, and
  only then is the trie built and traversed. Candidates are checked on the whole texts.

Sets of up to HEAD n-grams are in the tree whole, so every pair of two of them at the threshold is found; where only
the partner is longer, the prefix allows for all that its head lacks (16 n-grams at most), so these are found too. For two longer ones a
pair must share ``SHARED`` of its HEAD smallest n-grams; a pair of similarity 0.8 shares 51 on average and
fewer than 17 with a chance of 4e-21, less than the chance that two n-grams have the same 64-bit hash.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import arrow_map, components, cut_lineage, document_texts, release, small_batches
from tallyback.llm.families import whole_groups
from tallyback.llm.text import (
    U64, Rolling, byte_values, chunks, concat_ranges, lower_ascii, mix, signed, texts_of, word_bounds,
)

HEAD = 64
SHARED = 17  # n-grams that the heads of a pair of longer sets have in common
CROWD = 2048  # sets of a chunk; a task traverses two chunks, a few MB, and a set of a node of n is dealt n / CROWD times


def ngram_sets(texts: pa.Array, size: int):
    """Yield (row, sorted distinct 64-bit n-gram hashes) for every text of an array; texts without words have none."""
    for row0, row1, raw, bounds in chunks(texts):
        data = lower_ascii(raw)
        starts, ends, firsts = word_bounds(data, bounds)
        rolling = Rolling(Rolling(byte_values(data)).ranges(starts, ends))
        words = np.diff(firsts)
        grams = np.where(words >= size, words - size + 1, np.minimum(words, 1))
        begin = concat_ranges(firsts[:-1], grams)
        end = np.minimum(begin + size, np.repeat(firsts[1:], grams))
        hashes = rolling.ranges(begin, end)
        cut = np.zeros(len(words) + 1, np.int64)
        np.cumsum(grams, out=cut[1:])
        for i in range(row1 - row0):
            yield row0 + i, np.unique(hashes[cut[i] : cut[i + 1]])


def parity_signature(grams: np.ndarray) -> bytes:
    """One parity bit per slot, slots a power of two and at least as many as n-grams (64 at least)."""
    slots = max(64, 1 << int(max(len(grams) - 1, 0)).bit_length())
    bits = np.bincount((grams >> U64(7) & U64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def overlap_bound(n_a: int, sig_a: bytes, n_b: int, sig_b: bytes) -> int:
    """Upper bound of the common n-grams: every slot of unlike parity stands for an n-gram of one set only."""
    a, b = np.unpackbits(np.frombuffer(sig_a, np.uint8)), np.unpackbits(np.frombuffer(sig_b, np.uint8))
    small = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, small), axis=0) for x in (a, b))  # slots are taken modulo a power of two
    return (n_a + n_b - int(np.count_nonzero(a != b))) // 2


def _needed_of(n: Column, percent: int) -> Column:
    """N-grams a set of ``n`` shares with any partner at the threshold."""
    return F.floor((n * percent + 99) / 100).cast("long")


def _least_of_heads(n: Column, percent: int) -> Column:
    """N-grams the head of a set of ``n`` shares with the head of any partner at the threshold.

    The largest partner of a set of up to HEAD may be cut itself: at worst all it lost was shared. Where that
    leaves fewer than SHARED, and for longer sets, it is SHARED.
    """
    needed = _needed_of(n, percent)
    largest = F.floor(n * 100 / percent)
    shared = F.floor(((n + largest) * percent + 99 + percent) / (100 + percent)).cast("long")
    cut = shared - F.greatest(largest - HEAD, F.lit(0))
    return F.when(n <= HEAD, F.least(needed, F.greatest(cut, F.lit(SHARED)))).otherwise(F.least(needed, F.lit(SHARED)))


class Signatures:
    """Parity signatures of a node's sets, compared one against all at once."""

    def __init__(self, n: np.ndarray, signatures: list[bytes]):
        self.n = n
        self.slots = np.array([len(s) * 8 for s in signatures])
        self._bits = [np.unpackbits(np.frombuffer(s, np.uint8)) for s in signatures]
        self._tables: dict[int, np.ndarray] = {}

    def _folded(self, i: int, slots: int) -> np.ndarray:
        return np.packbits(np.bitwise_xor.reduce(self._bits[i].reshape(-1, slots), axis=0)).view(np.uint64)

    def _table(self, slots: int) -> np.ndarray:
        """All sets of ``slots`` slots or more, folded to that many; zeros for the others."""
        if slots not in self._tables:
            table = np.zeros((len(self.n), slots // 64), np.uint64)
            for i in np.flatnonzero(self.slots >= slots):
                table[i] = self._folded(i, slots)
            self._tables[slots] = table
        return self._tables[slots]

    def possible(self, i: int, percent: int) -> np.ndarray:
        """Which sets the threshold leaves room for, by length and parity."""
        fits = np.minimum(self.n, self.n[i]) * 100 >= np.maximum(self.n, self.n[i]) * percent
        for slots in np.unique(np.minimum(self.slots[fits], self.slots[i])):
            at = np.flatnonzero(fits & (np.minimum(self.slots, self.slots[i]) == slots))
            unlike = np.bitwise_count(self._table(slots)[at] ^ self._folded(i, slots)).sum(axis=1, dtype=np.int64)
            total = self.n[at] + self.n[i]
            fits[at] = (total - unlike) // 2 * (100 + percent) >= percent * total
        return fits


def _sketch(size: int):
    def step(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        n, keys, heads, signatures = [], [], [], []
        for _, grams in ngram_sets(texts, size):
            n.append(len(grams))
            keys.append((mix(grams).sum(dtype=U64), np.bitwise_xor.reduce(mix(grams + U64(1)), initial=U64(0))))
            heads.append(np.sort(signed(grams[:HEAD])))
            signatures.append(parity_signature(grams) if len(grams) else b"")
        keys = signed(np.array(keys, U64).reshape(-1, 2))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
             pa.array(heads, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            ["doc_id", "n", "k1", "k2", "head", "sig"],
        )

    return step


def _surviving(percent: int):
    """Pairs whose parity signatures leave room for the threshold."""

    def step(batch: pa.RecordBatch):
        rows = [batch.column(i).to_pylist() for i in range(6)]
        keep = [
            overlap_bound(na, sa, nb, sb) * (100 + percent) >= percent * (na + nb) for _, _, na, nb, sa, sb in zip(*rows)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return step


def _verified(size: int, percent: int):
    """Pairs of texts that reach the threshold on their whole sets."""

    def step(batch: pa.RecordBatch):
        keep = []
        left = ngram_sets(texts_of(batch.column(2)), size)
        right = ngram_sets(texts_of(batch.column(3)), size)
        for (_, a), (_, b) in zip(left, right):
            common = len(a) + len(b) - len(np.union1d(a, b))
            keep.append(bool(common) and 100 * common >= percent * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return step


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those candidate pairs (a, b) that reach the threshold."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    sketched = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    )
    likely = cut_lineage(arrow_map(sketched.select("a", "b", "n_a", "n_b", "sig_a", "sig_b"), _surviving(percent), "a long, b long"))
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    links = cut_lineage(arrow_map(both, _verified(size, percent), "a long, b long"))
    release(likely)
    return links


class Trie:
    """Ordered n-gram lists that share their beginnings."""

    def __init__(self):
        self.children: dict[int, Trie] = {}
        self.ends: list[int] = []  # sets that end here
        self.longest = 0  # n-grams still to come on the longest path

    def add(self, grams: list[int], owner: int) -> None:
        node = self
        for left, gram in zip(range(len(grams), 0, -1), grams):
            node.longest = max(node.longest, left)
            node = node.children.setdefault(gram, Trie())
        node.ends.append(owner)

    def overlapping(self, grams: list[int], needed: int, first: int) -> list[tuple[int, int]]:
        """Sets that share ``needed`` or more n-grams with ``grams``, ``first`` before all others, each with the number shared."""
        found, stack, size = [], [(self, 0, 0)], len(grams)
        while stack:
            node, place, common = stack.pop()
            if common >= needed:
                found += [(owner, common) for owner in node.ends]
            for gram, child in node.children.items():
                at = bisect_left(grams, gram, place)
                hit = at < size and grams[at] == gram
                if not common and (gram > first if not hit else gram != first):
                    continue  # they meet at the node of an earlier n-gram, or have none in common up to this one
                count = common + hit
                # Remaining length, of the set and of the subtree, bounds what can still be shared.
                if count + min(size - at - hit, child.longest) >= needed:
                    stack.append((child, at + hit, count))
        return found


def _possible(row, gram, node, comp, least):
    """Entries (row, gram) that can count: the gram is in sets of two components of its node, the row has ``least`` such grams.

    Dropping a row may leave others with too few, so this is repeated until nothing changes.
    """
    while len(row):
        order = np.lexsort((gram, node[row]))
        row, gram = row[order], gram[order]
        first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (node[row][1:] != node[row][:-1])))
        owner = comp[row]
        crossing = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        crossing = np.repeat(crossing, np.diff(np.append(first, len(row))))
        count = np.bincount(row[crossing], minlength=len(least))
        keep = crossing & (count >= least)[row]
        if keep.all():
            break
        row, gram = row[keep], gram[keep]
    order = np.lexsort((gram, row))
    return row[order], gram[order]


def _traverse(percent: int):
    """Candidate pairs of different components in every node (or pair of its chunks)."""

    def needed(n_a: int, n_b: int) -> int:
        whole = -(-percent * (n_a + n_b) // (100 + percent))
        return whole if max(n_a, n_b) <= HEAD else min(whole, SHARED)

    def node_pairs(first, ids, n, comp, chunk, least, lists, signatures):
        owner, count = np.unique(comp, return_counts=True)
        if len(owner) < 2:
            return []
        trie, largest = None, owner[count.argmax()]
        parity = Signatures(np.array(n), signatures)
        crossed = chunk.min() != chunk.max()
        pairs = []
        for i in range(len(ids)):
            if comp[i] == largest:
                continue  # met by the sets of the other components
            fits = parity.possible(i, percent) & (comp != comp[i])
            if not fits.any():
                continue
            if trie is None:
                trie = Trie()
                for k, grams in enumerate(lists):
                    trie.add(grams, k)
            for j, common in trie.overlapping(lists[i], least[i], first):
                if fits[j] and not (crossed and chunk[i] == chunk[j]) and common >= needed(n[i], n[j]):
                    pairs.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pairs

    def run(batches):
        for rows in whole_groups(batches, rows=4000):
            g, node, c1, c2, ids, n, comp, chunk = (rows.column(i).to_numpy() for i in range(8))
            heads, signatures = rows.column(8).combine_chunks(), rows.column(9).to_pylist()
            flat = heads.flatten()
            # Numbers that follow the global order (how many heads have it, n-gram) within this batch.
            rank, gram = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            order = np.lexsort((gram, rank))
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(np.append(False, gram[order][1:] != gram[order][:-1])) if len(order) else 0
            own_gram = np.full(len(g), -1)
            owner = np.repeat(np.arange(len(g)), heads.value_lengths().to_numpy(zero_copy_only=False))
            own_gram[owner[gram == node[owner]]] = place[gram == node[owner]]
            new = np.ones(len(g), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in (g, node, c1, c2)], axis=0)
            group = np.cumsum(new) - 1
            least = -(-percent * n // 100)
            least = np.where(n * 100 <= HEAD * percent, least, np.minimum(least, SHARED))
            row, gram = _possible(owner, place, group, comp, least)
            alive, first = np.unique(row, return_index=True)
            lists = [part.tolist() for part in np.split(gram, first[1:])] if len(alive) else []
            cuts = np.searchsorted(group[alive], np.arange(group[-1] + 2))
            found = set()
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = alive[lo:hi]
                if hi - lo > 1 and not (c1[own[0]] != c2[own[0]] and (chunk[own] == chunk[own[0]]).all()):
                    found.update(
                        node_pairs(int(own_gram[own[0]]), ids[own].tolist(), n[own].tolist(), comp[own], chunk[own], least[own].tolist(), lists[lo:hi],
                                   [signatures[k] for k in own])
                    )
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _ordered_heads(sets: DataFrame) -> DataFrame:
    """Per set the n-grams of its head that another head has too, in the global order: doc_id, n, grams (heads, gram), weight."""
    entries = sets.select("doc_id", "n", F.explode("head").alias("gram"))
    counts = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("heads")).filter("heads > 1")
    shared = entries.join(counts, "gram").groupBy("doc_id", "n")  # HEAD rows at most
    grams = F.sort_array(F.collect_list(F.struct("heads", "gram"))).alias("grams")
    found = shared.agg(grams, F.sum("heads").alias("weight"))
    return cut_lineage(found.join(sets.select("doc_id", "sig"), "doc_id"))


def _prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """Nodes each set belongs to (node, doc_id, n, weight): the first n-grams of its head, as far as another head has them."""
    size = F.least("n", F.lit(HEAD))
    length = size - _least_of_heads(F.col("n"), percent) + 1
    alone = size - F.size("grams")  # the rarest of all
    room = F.greatest(length - alone, F.lit(0)).cast("int")
    exploded = ordered.select("doc_id", "n", "weight", F.explode(F.slice("grams", F.lit(1), room)).alias("g"))
    return exploded.select(F.col("g.gram").alias("node"), "doc_id", "n", "weight")


def _crossing_prefixes(ordered: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Nodes by what sets of different components can share (node, doc_id, n, comp).

    An n-gram that only one component has counts as one that no other head has, so that a set of near copies whose other n-grams
    can't reach the overlap is in no node, however many copies there are.
    """
    owned = ordered.join(comp, "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("comp"), "grams")
    entries = owned.select("doc_id", "n", "comp", F.explode("grams").alias("g")).select("doc_id", "n", "comp", "g.heads", "g.gram")
    owners = entries.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("gram")
    grams = F.sort_array(F.collect_list(F.struct("heads", "gram"))).alias("grams")
    kept = entries.join(owners, "gram").groupBy("doc_id", "n", "comp").agg(grams)  # HEAD rows at most
    room = F.greatest(F.size("grams") - _least_of_heads(F.col("n"), percent) + 1, F.lit(0)).cast("int")
    exploded = kept.select("doc_id", "n", "comp", F.explode(F.slice("grams", F.lit(1), room)).alias("g"))
    return exploded.select(F.col("g.gram").alias("node"), "doc_id", "n", "comp")


def _dealt(level: DataFrame, crowd: int) -> DataFrame:
    """Sets of the nodes (node, doc_id, n, comp) that hold two components, once for every chunk they meet (chunk, other).

    The largest component of a crowded node is never paired with itself: its chunks go to the chunks of the others only.
    """
    owners = level.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("own"))
    stats = owners.groupBy("node").agg(F.sum("own").alias("size"), F.max(F.struct("own", "comp")).alias("top")).filter("size > top.own")
    mixed = level.join(stats, "node")
    host = (F.col("size") > crowd) & (F.col("comp") == F.col("top.comp"))
    guests = F.when(F.col("size") > crowd, F.ceil((F.col("size") - F.col("top.own")) / crowd)).otherwise(1).cast("int")
    hosts = F.when(F.col("size") > crowd, F.ceil(F.col("top.own") / crowd)).otherwise(0).cast("int")
    parted = mixed.select("node", "doc_id", "n", "comp", host.alias("host"), guests.alias("guests"), hosts.alias("hosts"))
    at = lambda parts: F.pmod(F.xxhash64("doc_id"), F.greatest(parts, F.lit(1))).cast("int")
    own = F.when(F.col("host"), F.col("guests") + at(F.col("hosts"))).otherwise(at(F.col("guests")))
    chunked = parted.withColumn("chunk", own)
    last = F.col("guests") + F.when(F.col("host"), 0).otherwise(F.col("hosts")) - 1
    return chunked.withColumn("other", F.explode(F.sequence(F.lit(0), last)))


def _tree_pairs(level: DataFrame, ordered: DataFrame, percent: int, crowd: int) -> DataFrame:
    """Candidate pairs of different components from the nodes (node, doc_id, n, comp)."""
    dealt = _dealt(level, crowd)
    dealt = dealt.withColumn("c1", F.least("chunk", "other")).withColumn("c2", F.greatest("chunk", "other"))
    group = ["node", "c1", "c2"]
    dealt = dealt.withColumn("g", F.xxhash64(*group)).join(ordered.select("doc_id", "grams", "sig"), "doc_id")
    dealt = dealt.select("g", *group, "doc_id", "n", "comp", "chunk", "grams", "sig").repartition("g").sortWithinPartitions("g", *group)
    return cut_lineage(small_batches(dealt).mapInArrow(_traverse(percent), "a long, b long").distinct())


def ngram_components(
    docs: DataFrame, size: int = 5, percent: int = 80, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Link documents whose word n-gram sets have a Jaccard similarity of ``percent`` per cent or more.

    One row per row of ``docs``: doc_id, n_shingles (set size) and component_id (smallest doc_id reachable by
    links, itself included). Words are runs of characters other than space and tab to carriage return,
    A-Z in lower case; a text of fewer than ``size`` words has one n-gram, the whole sequence. Null, empty and blank
    texts have none and are linked with nothing. doc_id must be unique (rows repeated in full are the same document);
    a row without doc_id is linked with nothing and has a null component. An empty table gives
    an empty result; other columns are not read.
    """
    texts = document_texts(docs, id_col, text_col)
    sketched = cut_lineage(
        arrow_map(texts, _sketch(size), "doc_id long, n long, k1 long, k2 long, head array<long>, sig binary")
    )
    usable = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(usable.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("class_id")))
    sets = cut_lineage(
        usable.join(classes.select(F.col("class_id").alias("doc_id"), "k1", "k2", "n"), ["doc_id", "k1", "k2", "n"])
        .select("doc_id", "n", "head", "sig").dropDuplicates(["doc_id"])
    )

    ordered = _ordered_heads(sets)
    prefixes = _prefixes(ordered, percent)
    # The set with the most widely shared n-grams stands in the middle of its near copies: most others link with it.
    middle = F.max(F.struct("weight", (-F.col("doc_id")).alias("id"))).alias("middle")
    nodes = prefixes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), middle).filter("size > 1")
    level = cut_lineage(prefixes.join(nodes.select("node", (-F.col("middle.id")).alias("centre")), "node").drop("weight"))
    stars = cut_lineage(level.filter("doc_id != centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct())
    near = _links(stars, sets, texts, size, percent)
    comp = components(near).select(F.col("id").alias("doc_id"), "component")
    start = cut_lineage(_crossing_prefixes(ordered, comp, percent))
    release(stars, level)
    far = _links(_tree_pairs(start, ordered, percent, crowd), sets, texts, size, percent)
    release(start, ordered)
    comp = components(near.union(far))

    # One row per class here; the only join that meets a hot class is the last, between shuffles that can be split.
    rooted = classes.join(comp.withColumnRenamed("id", "class_id"), "class_id", "left")
    rooted = rooted.select("k1", "k2", "n", F.coalesce("component", "class_id").alias("root"))
    joined = sketched.select("doc_id", "n", "k1", "k2").join(rooted, ["k1", "k2", "n"], "left")
    root = F.coalesce("root", "doc_id")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), root).otherwise(F.col("doc_id")).alias("component_id")
    )
