"""Repeated bytes and words against brute force, with crowded groups and without."""

import random
from collections import defaultdict

import pytest

from tallyback.llm.substring_kmer import remove_repeated_words, repeated_word_runs
from tallyback.llm.substring_suffix import remove_repeated_bytes, repeated_byte_runs


def texts(seed, n=40):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(["ab", "c", "dé", "e"]) for _ in range(30)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("xyz é\n") for _ in range(rng.randint(0, 40))) for _ in range(4)]
        out.append((i, " ".join(parts)))
    return [*out, (n, "a" * 70), (n + 1, "a" * 55), (n + 2, "ab " * 30), (n + 3, None), (n + 4, "")]


def covered_bytes(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone |= set(range(i, i + length))
            seen.add(piece)
        out[doc] = gone
    return out


def covered_words(rows, window):
    places, out = defaultdict(list), {doc: set() for doc, _ in rows}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            places[tuple(words[i : i + window])].append((doc, i))
    for found in places.values():
        if len(found) > 1:
            for doc, i in found:
                out[doc] |= set(range(i, i + window))
    return out


def spread(runs):
    out = defaultdict(set)
    for r in runs.collect():
        out[r.doc_id] |= set(range(r.start, r.end))
    return out


@pytest.mark.parametrize("seed,length,gram,crowd", [(1, 20, 8, 1024), (2, 20, 8, 1), (3, 13, 5, 3)])
def test_bytes(spark, seed, length, gram, crowd):
    rows = texts(seed)
    got = spread(repeated_byte_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length, gram, crowd))
    want = covered_bytes(rows, length)
    assert {d: s for d, s in want.items() if s} == dict(got)


@pytest.mark.parametrize("seed,window,gram,crowd", [(1, 7, 3, 64), (2, 7, 3, 1), (3, 4, 2, 2)])
def test_words(spark, seed, window, gram, crowd):
    rows = texts(seed)
    got = spread(repeated_word_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window, gram, crowd))
    want = covered_words(rows, window)
    assert {d: s for d, s in want.items() if s} == dict(got)


def test_odd_rows(odd_docs, nulled_docs):
    by = {r.doc_id: r for r in remove_repeated_words(odd_docs).collect()}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].kept == ""
    assert by[6].kept == "four" and by[5].kept == by[10].kept == "" and by[4].n_removed == 0
    by = {r.doc_id: r for r in remove_repeated_bytes(odd_docs).collect()}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[3].n_bytes == 4
    assert by[5].n_removed == 0 and by[10].n_removed == by[10].n_bytes and by[10].kept == b""
    assert len(by[6].removed) == 1 and by[4].n_removed == 0
    assert remove_repeated_bytes(nulled_docs).count() == remove_repeated_words(nulled_docs).count() == 12
    assert remove_repeated_bytes(odd_docs.limit(0)).count() == remove_repeated_words(odd_docs.limit(0)).count() == 0


def test_repeated_long_rows_are_one_document(spark):
    words = [f"w{i}x{i * 7 % 13}" for i in range(400)]
    share, own = " ".join(words[:120]), " ".join(words[120:300])
    rows = [(5, f"{share} {own}"), (5, f"{share} {own}"), (9, f"tail {share} end"), (7, "a" + own), (7, "b" + share), (None, share), (None, share)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = spark.createDataFrame([(5, f"{share} {own}"), (9, f"tail {share} end"), (7, "a" + own)], "doc_id long, text string")
    for remove in (remove_repeated_bytes, remove_repeated_words):
        want = {r.doc_id: tuple(r) for r in remove(plain).collect()}
        got = remove(docs).collect()
        assert len(got) == 7 and [tuple(r) for r in got if r.doc_id in (5, 9)].count(want[5]) == 2
        assert want[9] in [tuple(r) for r in got] and sorted(r.n_removed for r in got if r.doc_id == 7) == sorted([0, want[7][2]])
        assert all(r.n_removed == 0 for r in got if r.doc_id is None)
        if remove is remove_repeated_bytes:
            assert want[5][2] == 0 and want[9][2] >= len(share)
