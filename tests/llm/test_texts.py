"""Line spread, mixing, classifier, preferences, fingerprints and BPE: edge rows and brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyback.llm.bpe import Codec, encode_texts, merge_table, parse_ranks, replay_merges
from tallyback.llm.fingerprints import Sampler, compare_edited_and_next, fingerprint_texts, likeness
from tallyback.llm.line_dedup import remove_widespread_lines
from tallyback.llm.mixing import mix_sources, mixed_documents
from tallyback.llm.preferences import format_preferences
from tallyback.llm.pu_quality import (
    FEATURES, HIDDEN, Network, estimate_prior, feature_moments, keep_good_documents, risk_step, score_quality, tail_counts,
    train, unlabelled_sums,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# Lines


def test_lines_by_hand(spark):
    lines = [(i, f"own {i}\nshared\n\n  shared \nend", f"s{i % 3}") for i in range(6)] + [(9, "shared", None), (10, None, "s1"), (11, "", "s2")]
    got = {r.doc_id: r for r in remove_widespread_lines(spark.createDataFrame(lines, "doc_id long, text string, source string"), min_sites=3).collect()}
    assert got[0].text == "own 0\n" and (got[0].n_lines, got[0].n_dropped) == (5, 3)  # "end" is shared too
    assert got[9].text == "" and got[9].n_dropped == 1
    assert got[10].text is None and got[10].n_lines == 0 and got[11].text == "" and got[11].n_dropped == 0


def test_lines_spread_far_above_and_around_the_threshold(spark):
    rows = [(i * 100 + k, f"line {i}", f"site {k}") for i, n in enumerate((39, 40, 41, 60, 300)) for k in range(n)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)] + [(10_000 + n, "line 0", "site 1") for n in range(50)]
    got = remove_widespread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=40).collect()
    assert Counter(r.n_dropped for r in got) == {1: 40 + 41 + 60 + 300, 0: 89}


def test_lines_odd(odd_docs, nulled_docs):
    out = remove_widespread_lines(nulled_docs, min_sites=2)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_dropped"] and out.count() == 12
    assert remove_widespread_lines(odd_docs.limit(0)).count() == 0


# Mixing


def test_mix_shares(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 9))), "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    total = sum(r.size for r in got)
    assert total - 9 <= sum(r.taken for r in got) <= total
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=20)
        assert own[0].source_size == sum(r.size for r in own) and own[0].target <= 3 * own[0].source_size
        assert all(r.taken <= 3 * r.size for r in own)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs.repartition(5)).collect()))
    assert mixed_documents(docs).count() == sum(r.copies for r in got)


def test_mix_odd(odd_docs, nulled_docs):
    got = mix_sources(nulled_docs).collect()
    assert len(got) == 12 and all(r.taken == 0 for r in got if r.size == 0)
    assert {r.target for r in got if r.doc_id == 3} == {r.target for r in got if r.doc_id == 10}  # null is one source
    assert mixed_documents(nulled_docs).columns == odd_docs.columns
    assert mix_sources(odd_docs.limit(0)).count() == 0


# Quality


def test_quality_on_held_out_labels(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = score_quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    held = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)
    kept = keep_good_documents(docs, labels)
    assert kept.schema == docs.schema and kept.count() == got.filter("predicted = 1").count()


def test_prior_is_found():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (8000, 21)), rng.normal(2.5, 1, (1500, 21))
    assert estimate_prior(good[:4000], np.concatenate([good[4000:7500], bad])) == pytest.approx(0.7, abs=0.06)


def test_risk_over_all_rows(spark):
    """Moments, tails, risk and gradient of a table against plain sums and finite differences, on both branches of the risk."""
    rng = np.random.default_rng(3)
    rows = rng.normal(0, 1, (700, len(FEATURES)))
    table = spark.createDataFrame([(r.tolist(),) for r in rows], "features array<float>").repartition(5)
    plain = np.array(rows, np.float32).astype(float)
    n, mean, scale = feature_moments(table)
    assert n == 700 and np.allclose(mean, plain.mean(0)) and np.allclose(scale, plain.std(0) + 1e-6)
    shapes = [(len(FEATURES), HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]
    net = Network(mean, scale, [rng.normal(0, 0.5, s) for s in shapes])
    at = np.quantile(net.margin(plain), [0.1, 0.5, 0.9])
    assert tail_counts(table, net, at)[1].tolist() == [(net.margin(plain) >= t).sum() for t in at]
    positive = net.standard(rng.normal(0.5, 1, (90, len(FEATURES))))

    def parts(prior):
        own, f = net.forward(positive)[1], net.margin(plain)
        return prior * np.logaddexp(0, -own).mean(), np.logaddexp(0, f).mean() - prior * np.logaddexp(0, own).mean()

    for prior, expect in ((0.3, lambda p, u: p + u), (30.0, lambda p, u: -u)):
        risk, grads = risk_step(net, positive, n, *unlabelled_sums(table, net), prior)
        assert (parts(prior)[1] >= 0) == (prior == 0.3) and risk == pytest.approx(parts(prior)[0] + max(0, parts(prior)[1]))
        for w, g in zip(net.weights, grads):
            place = tuple(0 for _ in w.shape)
            values = []
            for move in (1e-5, -2e-5):
                w[place] += move
                values.append(expect(*parts(prior)))
            w[place] += 1e-5
            assert g[place] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-4, abs=1e-7)


def test_fit_agrees_with_itself(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts = docs.select("doc_id", "text")
    one, two = train(texts, labels), train(texts.repartition(7), labels)
    assert one.prior == two.prior and all(np.allclose(a, b, atol=1e-4) for a, b in zip(one.weights, two.weights))


def test_quality_odd(spark, odd_docs, nulled_docs):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert [r.score for r in score_quality(nulled_docs, labels).collect()] == [0.5] * 12
    assert score_quality(odd_docs.limit(0), labels).count() == 0
    assert keep_good_documents(nulled_docs, labels).columns == odd_docs.columns


# Preferences

TURNS = "pair_id long, turn long, role string, text string, c string, n_common int"


def test_preferences(spark):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "why")]
    other = [(1, 0, "user", "hi"), (1, 1, "assistant", "no")]
    more = [(2, 0, None, None), (2, 1, "assistant", "a")]
    left = [*talk, *more, (3, 0, "user", "alone"), (None, 0, "user", "lost"), (4, 0, "user", "same")]
    right = [*other, *more, (4, 0, "user", "same"), (4, 1, "assistant", "longer")]
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    got = {r.pair_id: r for r in format_preferences(frame(left), frame(right)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].n_common == 1 and got[1].prompt == "<|user|>\nhi<|end|>\n"
    assert got[1].chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nwhy<|end|>\n" and got[1].rejected == "<|assistant|>\nno<|end|>\n"
    assert [got[1].chosen[s.start : s.end] for s in got[1].chosen_spans] == ["yes<|end|>"]
    assert [got[1].rejected[s.start : s.end] for s in got[1].rejected_spans] == ["no<|end|>"]
    assert got[2].n_common == 2 and got[2].chosen == got[2].rejected == "" and got[2].prompt.startswith("<|none|>\n<|end|>")
    assert got[3].prompt == "" and got[3].rejected == "" and got[3].chosen == "<|user|>\nalone<|end|>\n"
    assert got[4].chosen == "" and got[4].chosen_spans == [] and got[4].rejected == "<|assistant|>\nlonger<|end|>\n"
    assert format_preferences(frame([]), frame([])).count() == 0


# Fingerprints


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    sampler = Sampler(2048)
    for share in (0.1, 0.5, 0.9):
        a = rng.choices(words, k=150)
        b = [w if rng.random() < share else rng.choice(words) for w in a]
        rng.shuffle(b)
        a, b = " ".join(a), " ".join(b)
        s = sampler.signatures(pa.array([a, b, a], pa.large_string()))
        assert likeness(s[:1], s[1:2])[0] == pytest.approx(jaccard(a, b), abs=0.05)
        assert (s[0] == s[2]).all()


def test_edited_and_next(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(docs.select("doc_id", F.coalesce("text", F.lit(""))).collect())
    ids = sorted(texts)
    got = {r.doc_id: r for r in compare_edited_and_next(docs).collect()}
    whole = {r.doc_id: r.fingerprint for r in fingerprint_texts(docs).collect()}
    assert set(got) == set(ids)
    errors = []
    for at, i in enumerate(ids):
        mine, after = texts[i], texts[ids[(at + 1) % len(ids)]]
        edited = mine[: len(mine) - len(mine) // 2] + after[: len(mine) // 2]
        assert got[i].edited == edited and got[i].n_chars == len(mine) and got[i].fingerprint == whole[i]
        errors += [got[i].near_edited - jaccard(mine, edited), got[i].near_next - jaccard(mine, after)]
    assert np.abs(errors).mean() < 0.04 and abs(np.mean(errors)) < 0.01
    equal = {}
    for i in ids:
        assert equal.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint


def test_fingerprints_odd(odd_docs, nulled_docs):
    got = {r.doc_id: r for r in compare_edited_and_next(odd_docs).collect()}
    assert len(got) == 10 and got[1].near_edited == 1.0 and got[1].near_next == 1.0 and got[1].fingerprint.strip("0") == ""
    assert got[9].edited == "a a a a one two"[:8] + "one two"[:7] and got[10].near_next == 0.0  # the next of the last is the first, empty
    assert compare_edited_and_next(nulled_docs).count() == 12
    assert compare_edited_and_next(odd_docs.filter("doc_id = 7")).first().near_next == 1.0
    assert compare_edited_and_next(odd_docs.limit(0)).count() == fingerprint_texts(odd_docs.limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as lines:
        ranks = parse_ranks(lines)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_on_random_text(plain):
    ranks, encoding = plain
    rng = random.Random(1)
    pieces = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "é", "中", "😀", " ", " ", "\x1c", "\x85", "1", "23", "!", "==", "﻿", "é"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(1500)] + ["a" * k for k in range(40)] + ["=" * 300, "ab" * 400, ""]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(25)) for _ in range(500)]
    for text, (ids, n, data) in zip(texts, Codec(ranks, public_tokenizers.PATTERN).encode(texts)):
        want = encoding.encode_ordinary(text)
        assert ids == " ".join(map(str, want)) and n == len(want) and data == text.encode()


def test_lower_ranks_that_a_merge_opens_go_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"ca": 310, b"bc": 305, b"abca": 270}
    words = [b"abcab", b"ababc", b"cabca", b"abab", b"aab"]
    encoding = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    letters = [ranks[bytes([b])] for b in range(256)]
    assert replay_merges(words, letters, merge_table(ranks)) == [encoding.encode_ordinary(w.decode()) for w in words]


def test_short_words_side_by_side_as_one_by_one(plain):
    """Whole arrays of short words give the ids of the inverted index, and long words never take that many rounds."""
    from tallyback.llm import bpe

    ranks, encoding = plain
    rng = random.Random(9)
    words = ["".join(rng.choices(["a", "b", "th", "ing", " ", "é", "1", "=", "中"], k=rng.randint(0, 14))).encode() for _ in range(3000)]
    words += [b"a" * n for n in range(60)]
    table, letters = merge_table(ranks), [ranks[bytes([b])] for b in range(256)]
    assert bpe.replay_side_by_side(words, letters, table) == replay_merges(words, letters, table)
    assert bpe.replay_side_by_side([], letters, table) == [] and bpe.replay_side_by_side([b""], letters, table) == [[]]
    codec = Codec(ranks, public_tokenizers.PATTERN)
    assert codec.replay(words) == replay_merges(words, letters, table)


def test_codec_forgets_the_rarer_half(monkeypatch, plain):
    monkeypatch.setattr("tallyback.llm.bpe.REMEMBERED_WORDS", 40)
    codec = Codec(plain[0], public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(60):
        text = "often " * 3 + " ".join(f"w{rng.randint(0, 300)}" for _ in range(15))
        ((ids, _, data),) = codec.encode([text])
        assert ids == " ".join(map(str, plain[1].encode_ordinary(text))) and data == text.encode()
        assert len(codec._known) + len(codec._older) < 120 and " often" in codec._known


def test_bpe_on_documents(spark, folder, plain):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in encode_texts(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = plain[1].encode_ordinary(text)
        assert (r.n_tokens, r.ids_text, bytes(r.decoded)) == (len(ids), " ".join(map(str, ids)), text.encode())


def test_bpe_odd(odd_docs, nulled_docs):
    got = {r.doc_id: r for r in encode_texts(nulled_docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[None].n_tokens == 0 and got[1].ids_text == ""
    assert bytes(got[7].decoded).decode() == "é ß 中文 😀 word"
    assert encode_texts(odd_docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
