"""Document fingerprints by consistent weighted sampling.

A text is a bag of words weighted by their counts. For every sample k and word w, hashes of the two
give r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1); the word's step is t = floor(ln(weight) / r + b) and
its draw ln a = ln c - r (t + 1 - b). The word with the smallest draw is the sample, together with its step.
Two texts agree in a sample with a probability equal to the generalised Jaccard similarity of
their weights, so the share of equal samples estimates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyback.llm.common import document_texts, small_batches
from tallyback.llm.text import U64, Rolling, byte_values, chunks, mix, texts_of, word_bounds

SAMPLES = 128
BLOCK = 128  # words whose draws are made together
TEXT_BYTES = 8 << 20  # texts whose common words are drawn once
SLOT_CHARS = 1 << 20  # documents of a slice that are compared together
_24 = np.float32(2.0**-24)
_ODD = U64(0x9E3779B97F4A7C15)


def _unit(bits: np.ndarray) -> np.ndarray:
    """24 random bits as a number strictly between 0 and 1."""
    return (bits.astype(np.float32) + np.float32(0.5)) * _24


class Sampler:
    """Signatures of weighted word bags; ``samples`` draws of 16 bits each."""

    def __init__(self, samples: int = SAMPLES):
        self._seeds = mix(np.arange(1, samples + 1, dtype=U64) * _ODD)[None, :]
        self.samples = samples

    def draws(self, words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per weighted word and sample: ln a and the step t. A few words at a time, so that their numbers stay in the cache."""
        draws = np.empty((len(words), self.samples), np.float32)
        steps = np.empty((len(words), self.samples), np.int32)
        for at in range(0, len(words), BLOCK):
            part = slice(at, at + BLOCK)
            draws[part], steps[part] = self._draws(words[part], weights[part])
        return draws, steps

    def _draws(self, words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = mix(words[:, None] ^ self._seeds)
        two = mix(one + U64(0x632BE59BD9B4E019))
        low = U64(0xFFFFFF)
        r = -np.log(_unit(one >> U64(40)) * _unit(one >> U64(16) & low))
        c = -np.log(_unit(two >> U64(40)) * _unit(two >> U64(16) & low))
        b = _unit((one & U64(0xFFF)) << U64(12) | two & U64(0xFFF))
        step = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
        return np.log(c) - r * (step + np.float32(1) - b), step.astype(np.int32)

    def signatures(self, texts: pa.Array) -> np.ndarray:
        """One row of ``samples`` 16-bit numbers per text; a text without words has all zeros."""
        out = np.zeros((len(texts), self.samples), np.uint16)
        lane = np.arange(self.samples)
        for row0, row1, data, bounds in chunks(texts, TEXT_BYTES):
            starts, ends, firsts = word_bounds(data, bounds)
            if len(starts) == 0:
                continue
            words = Rolling(byte_values(data)).ranges(starts, ends)
            row = np.repeat(np.arange(row1 - row0), np.diff(firsts))
            order = np.lexsort((words, row))
            words, row = words[order], row[order]
            new = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (row[1:] != row[:-1])))
            count = np.diff(np.append(new, len(words)))
            words, row = words[new], row[new]
            _, some, at = np.unique(mix(words + count.astype(U64) * _ODD), return_index=True, return_inverse=True)
            cut = np.searchsorted(row, np.arange(row1 - row0 + 1))
            draws, steps = self.draws(words[some], count[some])
            words = words[some]
            for i in range(row1 - row0):
                own = at[cut[i] : cut[i + 1]]
                if len(own):
                    best = own[draws[own].argmin(axis=0)]
                    tag = mix(words[best] + steps[best, lane].astype(U64) * _ODD)
                    out[row0 + i] = np.maximum(tag >> U64(48), U64(1)).astype(np.uint16)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples per row; two texts without words are alike."""
    return (a == b).mean(axis=1)


def hex_rows(signatures: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signatures.astype(">u2")]


def fingerprint_texts(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and fingerprint, ``samples`` numbers of 16 bits in hexadecimal.

    Equal texts have equal fingerprints; texts without words (null and empty ones too) have all zeros and agree
    only with each other. Repeated rows are fingerprinted row by row, a null doc_id stays null, an empty
    table gives an empty result, other columns are not read.
    """
    sampler = Sampler(samples)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hex_rows(sampler.signatures(texts_of(batch.column(1)))))], ["doc_id", "fingerprint"]
            )

    return small_batches(document_texts(docs, id_col, text_col)).mapInArrow(run, "doc_id long, fingerprint string")


def with_successor(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (slice, doc_id, text, guest) dealt out so that each row's successor is in its slice, and the number of slices.

    Slices are ranges of doc_id (null last). The first row of every slice also goes to the slice before it as a
    guest, that of the first slice to the last one; only these few rows travel twice. Slice
    borders come from a quantile sketch: one number per slice reaches the driver.
    """
    keyed = docs.withColumn("place", F.coalesce("doc_id", F.lit(2**63 - 1)))
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = keyed.agg(F.percentile_approx("place", [i / wanted for i in range(1, wanted)] or [0.5], 10_000)).first()[0] or []
    borders = F.array(*[F.lit(b) for b in sorted(set(borders))]).cast("array<bigint>")
    sliced = keyed.withColumn("slice", F.size(F.filter(borders, lambda b: b <= F.col("place"))))
    # The first doc_id of each slice that has rows, and the slice before it (one row per slice).
    heads = sliced.groupBy("slice").agg(F.min("place").alias("head"))
    ring = Window.orderBy("slice")
    heads = heads.select("head", F.coalesce(F.lag("slice").over(ring), F.max("slice").over(Window.partitionBy())).alias("host")).collect()
    hosts = F.create_map(*[x for row in heads for x in (F.lit(row.head).cast("long"), F.lit(row.host))]) if heads else F.create_map().cast("map<bigint,int>")
    targets = F.array_compact(
        F.array(
            F.struct("slice", F.lit(False).alias("guest")),
            F.when(hosts[F.col("place")].isNotNull(), F.struct(hosts[F.col("place")].alias("slice"), F.lit(True).alias("guest"))),
        )
    )
    return sliced.select("place", "doc_id", "text", F.inline(targets)), wanted


def compare_edited_and_next(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, an edited form of it, and compare both with it and with the next document.

    Rows: doc_id, n_chars (code points), edited (the last n_chars // 2 code points replaced by the first as
    many, or all, of the next document), fingerprint, edited_fingerprint, near_edited, near_next. The next
    document is that of the next larger doc_id, after the last the first; rows of one doc_id follow
    by text, null ids come last. Null text is empty text. A single row is its own successor; an empty
    table gives an empty result. Other columns are not read.
    """
    rows, slices = with_successor(document_texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))))
    dealt = rows.repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "guest", "place", "text")
    sampler = Sampler(samples)

    def judged(slot: list[tuple], after: tuple) -> pa.RecordBatch:
        texts = [r[1] for r in slot]
        following = [*texts[1:], after[1]]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]
        signatures = sampler.signatures(pa.array([*texts, after[1], *edited], pa.large_string()))
        n = len(slot)
        own, nxt, new = signatures[:n], signatures[1 : n + 1], signatures[n + 1 :]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in slot], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(edited),
             pa.array(hex_rows(own)), pa.array(hex_rows(new)), pa.array(likeness(own, new)), pa.array(likeness(own, nxt))],
            ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches) -> Iterator[pa.RecordBatch]:
        waiting, current, closed, held = [], None, False, 0
        for batch in batches:
            for part, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part != current:
                    waiting, current, closed, held = [], part, False, 0
                if closed:
                    continue  # further rows of the guest's doc_id
                if guest:
                    yield judged(waiting, (doc_id, text))
                    waiting, closed = [], True
                    continue
                waiting.append((doc_id, text))
                held += len(text)
                if held > SLOT_CHARS and len(waiting) > 1:
                    yield judged(waiting[:-1], waiting[-1])
                    waiting, held = waiting[-1:], len(text)

    return small_batches(dealt.select("slice", "guest", "doc_id", "text")).mapInArrow(
        run,
        "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
