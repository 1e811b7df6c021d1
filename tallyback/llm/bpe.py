"""Byte-level BPE encoding and decoding by merge replay.

A Python worker gathers the distinct pre-tokens ("words") that none of its tasks has met lately and encodes them
together. Short words are replayed side by side, one merge of each a round, over arrays of all their tokens. For longer ones an
inverted index leads from the rank of a token pair to the places where the pair stands, and the merges are replayed over all words in
rank order, each one touching only its own places and their neighbours. Documents are then put together from encoded words.
There is no shuffle: the work is one pass over the texts, and a lost task is simply repeated.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tallyback.llm.common import arrow_map, document_texts
from tallyback.llm.text import texts_of

# Words a worker remembers, the rarer half of which it then drops; a bound on memory, not on what is encoded.
REMEMBERED_WORDS = 320_000
# Bytes of words whose merges are replayed together; a bound on memory too.
REPLAYED_BYTES = 1 << 18
# Bytes of texts that are split into words at once, some ten times their size; a text longer than that is split alone.
SPLIT_BYTES = 2 << 20
# Longer words are encoded but not remembered.
LONG_WORD = 256
# Token numbers of a pair are packed into one integer; END stands behind every word.
SHIFT = 24
END = (1 << SHIFT) - 1
# Words of up to so many bytes are replayed side by side; longer ones would take too many rounds.
SHORT_BYTES = 48
NONE = 1 << 62


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class MergeTable(dict):
    """Rank of the merged token by pair, also for whole arrays of pairs: open addressing, so that a lookup is a few gathers."""

    def lay(self) -> MergeTable:
        keys, ranks = np.fromiter(self.keys(), np.int64, len(self)), np.fromiter(self.values(), np.int64, len(self))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.at = np.full(1 << self.bits, -1)
        self.rank = np.full(1 << self.bits, NONE)
        slot = self._slots(keys)
        while len(keys):
            free = self.at[slot] < 0
            self.at[slot[free]] = keys[free]
            placed = self.at[slot] == keys
            self.rank[slot[placed]] = ranks[placed]
            keys, ranks, slot = keys[~placed], ranks[~placed], slot[~placed] + 1 & (1 << self.bits) - 1
        return self

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where two tokens don't merge."""
        pairs = left << SHIFT | right
        slot = self._slots(pairs)
        held = self.at[slot]
        out = np.where(held == pairs, self.rank[slot], NONE)
        going = np.flatnonzero((held != pairs) & (held >= 0))
        while len(going):
            slot[going] = slot[going] + 1 & (1 << self.bits) - 1
            held, wanted = self.at[slot[going]], pairs[going]
            out[going[held == wanted]] = self.rank[slot[going[held == wanted]]]
            going = going[(held != wanted) & (held >= 0)]
        return out


def merge_table(ranks: dict[bytes, int]) -> MergeTable:
    """Rank of the merged token for every two tokens that merge, keyed by ``left << SHIFT | right``."""
    table = MergeTable()
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                table[left << SHIFT | right] = rank
    return table.lay()


def replay_side_by_side(words: list[bytes], letters: list[int], table: MergeTable) -> list[list[int]]:
    """``replay_merges`` for short words: each round does one merge in every word that has one left, of lowest rank and then leftmost."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes + 1)
    tokens = np.full(len(word), END, np.int64)
    inside = np.ones(len(word), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    tokens[inside] = np.array(letters, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    rank = np.append(table.find(tokens[:-1], tokens[1:]), NONE)
    done_words, done_tokens = [], []
    while len(word):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        lengths = np.diff(np.append(starts, len(word)))
        least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        left = least < NONE
        if not left.all():
            done_words.append(word[~left])
            done_tokens.append(tokens[~left])
            word, tokens, rank, least = word[left], tokens[left], rank[left], least[left]
        at = np.flatnonzero(rank == least)
        at = at[np.diff(word[at], prepend=-1) != 0]
        tokens[at] = rank[at]
        kept = np.ones(len(word), bool)
        kept[at + 1] = False
        word, tokens, rank = word[kept], tokens[kept], rank[kept]
        at -= np.arange(len(at))
        rank[at] = table.find(tokens[at], tokens[at + 1])  # END follows at the latest
        at = at[(at > 0) & (word[at - 1] == word[at])]
        rank[at - 1] = table.find(tokens[at - 1], tokens[at])
    word, tokens = np.concatenate(done_words), np.concatenate(done_tokens)
    word, tokens = word[tokens != END], tokens[tokens != END]
    ids = tokens[np.argsort(word, kind="stable")].tolist()
    borders = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
    return [ids[start:end] for start, end in zip([0, *borders], borders)]


def replay_merges(words: list[bytes], letters: list[int], table: dict[int, int]) -> list[list[int]]:
    """Token ids of every word: always the merge of lowest rank first, equal ranks from left to right.

    All words are laid out in one array of tokens linked to their neighbours. ``places`` is the
    inverted index from a pair's rank to the left places of its occurrences, and a heap yields the
    ranks in order; a merge may create a pair of lower rank, which the heap then yields next.
    ``letters`` gives the token of each byte, ``table`` what two tokens merge to (``merge_table``).
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)  # a word ends with END, which merges with nothing
    laid = np.full(int(ends[-1]) if len(words) else 0, END, np.int64)
    inside = np.ones(len(laid), bool)
    inside[ends - 1] = False
    laid[inside] = np.array(letters, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    tokens: list[int] = laid.tolist()  # -1: taken up by the token to its left
    after = list(range(1, len(tokens) + 1))
    before = list(range(-1, len(tokens) - 1))
    merged = table.get
    pairs, which = np.unique(laid[:-1] << SHIFT | laid[1:], return_inverse=True)
    ranks = np.array([merged(pair, -1) for pair in pairs.tolist()], np.int64)[which] if len(pairs) else pairs
    order = np.argsort(ranks, kind="stable")
    order = order[np.searchsorted(ranks[order], 0) :]
    steps = np.flatnonzero(np.diff(ranks[order], prepend=-1))
    places: dict[int, list[int]] = {
        rank: found.tolist() for rank, found in zip(ranks[order[steps]].tolist(), np.split(order, steps[1:]) if len(steps) else [])
    }
    pending = list(places)  # in order, so a heap already
    while pending:
        rank = heapq.heappop(pending)
        found = places.pop(rank, None)
        if found is None:
            continue
        found.sort()
        for done, left in enumerate(found, 1):
            token = tokens[left]
            if token < 0:
                continue
            right = after[left]
            if merged(token << SHIFT | tokens[right]) != rank:
                continue  # one of the two was merged meanwhile
            tokens[left], tokens[right] = rank, -1
            beyond, ahead = after[right], before[left]
            after[left] = beyond
            before[beyond] = left
            lower = False
            new = merged(rank << SHIFT | tokens[beyond])
            if new is not None:
                lower = new < rank
                if new in places:
                    places[new].append(left)
                else:
                    places[new] = [left]
                    heapq.heappush(pending, new)
            if ahead >= 0:
                new = merged(tokens[ahead] << SHIFT | rank)
                if new is not None:
                    lower = lower or new < rank
                    if new in places:
                        places[new].append(ahead)
                    else:
                        places[new] = [ahead]
                        heapq.heappush(pending, new)
            if lower and done < len(found):  # a merge of lower rank goes before the rest of this rank's places
                places[rank] = found[done:] + places.get(rank, [])
                heapq.heappush(pending, rank)
                break
    left_over = np.array(tokens, np.int64)
    kept = (left_over >= 0) & inside
    ids = left_over[kept].tolist()
    borders = np.cumsum(kept)[ends - 1].tolist() if len(words) else []
    return [ids[start:end] for start, end in zip([0, *borders], borders)]


class Codec:
    """Words to token ids and back, remembering what was encoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._token = {rank: token for token, rank in ranks.items()}
        self._digits = {rank: str(rank) for rank in self._token}
        self._letters = [ranks[bytes([b])] for b in range(256)]
        self._table = merge_table(ranks)
        self._find = regex.compile(pattern).findall
        # Words met lately, and those met before them: what is met again moves up, the rest goes with the older half.
        self._known: dict[str, tuple[str, int, bytes]] = {}
        self._older: dict[str, tuple[str, int, bytes]] = {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self._token[i] for i in ids])

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, int, bytes]]:
        digits, group, held = self._digits, [], 0
        for i, word in enumerate(words, 1):
            group.append(word.encode())
            held += len(group[-1])
            if held >= REPLAYED_BYTES or i == len(words):
                for ids in self.replay(group):
                    yield " ".join([digits[i] for i in ids]), len(ids), self.decode(ids)
                group, held = [], 0

    def replay(self, group: list[bytes]) -> list[list[int]]:
        """Token ids of every word, short words side by side and longer ones by the inverted index."""
        short = iter(replay_side_by_side([w for w in group if len(w) <= SHORT_BYTES], self._letters, self._table))
        long = iter(replay_merges([w for w in group if len(w) > SHORT_BYTES], self._letters, self._table))
        return [next(short if len(w) <= SHORT_BYTES else long) for w in group]

    def encode(self, texts: list[str]) -> Iterable[tuple[str, int, bytes]]:
        """Per text: ids as decimal text joined by one space, their number, and the bytes the ids stand for."""
        if len(self._known) > REMEMBERED_WORDS // 2:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        split = [self._find(text) for text in texts]
        met = set()
        for words in split:
            met.update(words)
        short, long = [], []
        for word in met:
            if word not in known:
                entry = older.pop(word, None)
                if entry is not None:
                    known[word] = entry
                else:
                    (short if len(word) <= LONG_WORD else long).append(word)
        known.update(zip(short, self.encode_words(short)))
        brief = dict(zip(long, self.encode_words(long)))
        for words in split:
            if not words:
                yield "", 0, b""
                continue
            found = map(known.__getitem__, words) if not brief else [known.get(w) or brief[w] for w in words]
            ids, numbers, parts = zip(*found)
            yield " ".join(ids), sum(numbers), b"".join(parts)


_codecs: dict[tuple[str, str], Codec] = {}  # one per Python worker, shared by all its tasks


def codec_for(name: str, pattern: str) -> Codec:
    """The worker's codec. A function of this module, so that a task finds the module's own memory and not a copy."""
    key = (name, pattern)
    if key not in _codecs:
        with open(SparkFiles.get(name), "rb") as lines:
            _codecs[key] = Codec(parse_ranks(lines), pattern)
    return _codecs[key]


def parts_of_bytes(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts, its second column, hold ``limit`` bytes or are one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).tolist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes) or not sizes:
        yield batch.slice(start)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text by the rank file and decode the ids again.

    Rows: doc_id, n_tokens, ids (array of int) as text ``ids_text`` (decimal, one space between), and ``decoded``
    (the ids' bytes). Matches of ``pattern`` are encoded separately; no special tokens. Null and empty
    texts have no tokens. Repeated rows are encoded row by row; a null doc_id stays null; an empty table
    gives an empty result; other columns are not read. The rank file travels with the job as a file of
    fixed size (``SparkContext.addFile``).
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]

    def step(batch: pa.RecordBatch):
        for part in parts_of_bytes(batch, SPLIT_BYTES):
            texts = texts_of(part.column(1)).to_pylist()
            rows = list(codec_for(name, pattern).encode(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.binary())],
                ["doc_id", "n_tokens", "ids_text", "decoded"],
            )

    return arrow_map(document_texts(docs, id_col, text_col), step, "doc_id long, n_tokens long, ids_text string, decoded binary")
