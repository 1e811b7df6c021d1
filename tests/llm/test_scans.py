"""Licence scans, hard negatives and spelling variants: brute force, edge rows, hand-made cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyback.llm import hard_negatives, spelling
from tallyback.llm.hard_negatives import mine_hard_negatives
from tallyback.llm.license_scan import BASE_PHRASES, NOTICES, parse_expression, scan_licences
from tallyback.llm.queries import documents
from tallyback.llm.spelling import TrieSlice, damaged, group_spellings

# Licences


@pytest.mark.parametrize(
    "line, valid, postfix",
    [
        ("MIT", True, "mit"),
        ("MIT OR Apache-2.0 AND ISC", True, "mit apache-2.0 isc and or"),
        ("(MIT or Apache-2.0) and GPL-2.0-only with Classpath-exception-2.0 */", True, "mit apache-2.0 or gpl-2.0-only classpath-exception-2.0 with and"),
        ("GPL-2.0+ is what we use", True, "gpl-2.0+"),
        ("(MIT OR ISC", False, None),
        ("MIT OR", False, None),
        ("OR MIT", False, ""),
        ("", False, ""),
        ("(MIT AND ISC) WITH x-exception", False, None),
    ],
)
def test_expressions(line, valid, postfix):
    read = parse_expression(line)
    assert read.valid is valid
    if postfix is not None:
        assert " ".join(v for _, v in read.postfix) == postfix


def test_expression_verdicts():
    accepted = frozenset({"mit", "isc"})
    verdicts = {"MIT": True, "GPL-3.0": False, "MIT AND GPL-3.0": False, "MIT OR GPL-3.0": True, "(GPL-3.0 OR MIT) AND ISC+": True, "GPL-3.0 WITH e-1 OR X": False}
    assert {line: parse_expression(line).evaluate(accepted) for line in verdicts} == verdicts
    deep = "(" * 5000 + "MIT" + ")" * 5000 + " AND ISC" * 5000
    assert parse_expression(deep).valid and parse_expression(deep).evaluate(accepted)


def _plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = {phrase: places(phrase) for phrase in BASE_PHRASES}
    every = sorted(i for found in base.values() for i in found)
    labels = sorted({BASE_PHRASES[p] for p, found in base.items() if found})
    own = sorted({*labels, *(NOTICES[p] for p in NOTICES if places(p))})
    return len(words), len(every), *((every[0], every[-1]) if every else (None, None)), ",".join(labels), ",".join(own)


def test_licences_against_a_plain_scan(spark, folder, nulled_docs):
    extra = [
        (901, "MIT LICENSE mit license\nApache\tLicense, Version 2.0; GNU General-Public license version 3"), (902, "éMIT license mit licenseé"),
        (903, "mit " * 70_000 + "license"), (904, "permission is hereby granted, free of charge, to any person obtaining a copy of"),
    ]
    docs = documents(spark, folder).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).union(nulled_docs.select("doc_id", "text"))
    got = scan_licences(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()
    want = Counter((r.doc_id, *_plain_scan(r.text)) for r in docs.collect())
    assert Counter(map(tuple, got)) == want and sum(r.n_base for r in got) > 3
    assert scan_licences(nulled_docs.limit(0)).count() == 0


def test_licence_findings(spark):
    text = "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC\nSPDX license identifier is a tag\nSPDX-License-Identifier: MIT AND\nreleased under the MIT License."
    row = scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [f.kind for f in row.findings] == ["expression", "broken", "base"]
    tag = row.findings[0]
    assert text[tag.start : tag.end].endswith("AND ISC") and tag.terms == ["gpl-2.0-only", "isc", "mit"] and tag.accepted is True
    assert row.labels == "gpl-2.0-only,isc,mit" and row.base_labels == "mit" and 0.95 < row.score <= 1


# Hard negatives


def _plain_mining(rows, positives=5, negatives=3):
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = set()
    for a, la, va in rows:
        if a % 50:
            continue
        scored = sorted((-score(va, vb), b, lb) for b, lb, vb in rows if b != a)
        for s, p, _ in [r for r in scored if r[2] == la][:positives]:
            window = [(n, -t) for t, n, lb in scored if lb != la and 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(a, p, i + 1, n, -s, t) for i, (n, t) in enumerate(window[:negatives])}
    return out


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    for name, size in (("CHUNK_ROWS", 60), ("BLOCK_ANCHORS", 4), ("SIDE_BY_SIDE", 2)):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [float(rng.randint(-3, 9)) for _ in range(3)]) for i in range(700)]  # many equal scores
    rows = [(i, lab, [0.0] * 3 if i == 100 else [-v for v in vec] if i == 150 else vec) for i, lab, vec in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    odd = spark.createDataFrame(
        [(None, 1, [1.0, 1.0, 1.0]), (1001, None, [1.0] * 3), (1002, 1, None), (1003, 1, [1.0, None, 1.0]), (1004, 1, [1.0, float("nan"), 1.0]),
         (1005, 1, [float("inf"), 1.0, 1.0]), (1006, 1, []), (1007, 1, [2.0])], df.schema,
    )
    fed = df.union(odd).union(df.filter("vec_id % 100 < 2")).withColumns({"score": F.lit("x"), "anchor": F.lit(1), "limits": F.lit(2)})
    got = mine_hard_negatives(fed, F.col("id") % 50 == 0, scale=F.col("v")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _plain_mining(rows)
    assert mine_hard_negatives(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_tiles_are_never_broadcast(spark):
    """Copies of the anchors' blocks grow with the chunks, which the planner does not see: they must not meet on the driver."""
    one = spark.range(40).select("id", F.lit("a").alias("label"), F.lit(2).alias("dim"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    chunks, blocks = hard_negatives._pack(one, 5, "chunk", []), hard_negatives._pack(one.filter("id < 10"), 4, "block", [])
    tiles = hard_negatives._tiles(chunks, blocks)
    assert "Broadcast" not in tiles._jdf.queryExecution().executedPlan().toString()
    pairs = sorted((c.id, a.id) for t in tiles.collect() for c in t.rows for a in t.anchors)
    assert pairs == sorted((c, a) for c in range(40) for a in range(10))


def test_hard_negatives_beyond_doubles(spark):
    big = 2.0**30
    rows = [(0, 0, [big, 1.0]), (1, 0, [big, 3.0]), (2, 1, [big * 0.75, 1.0]), (3, 1, [big * 0.75, 2.0])]
    got = mine_hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("id") == 0, scale=F.col("v")).collect()
    assert [(r.negative_id, r.negative_score) for r in got] == [(3, int(big) ** 2 * 3 // 4 + 2), (2, int(big) ** 2 * 3 // 4 + 1)]


# Spelling


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain_spelling(docs, every, ratio=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()}


@pytest.mark.parametrize("every", [199, 3])
def test_spelling_against_all_pairs(spark, nulled_docs, every):
    rng = random.Random(every)
    stems = ["receive", "accommodation", "aaaaaaab", "éclairs", "ÀÿÖßß", "banana", "bananas", "zzzzzz"]
    words = [w[:i] + c + w[i + k :] for w in stems for i in range(len(w)) for c in ("", "a", "é") for k in (0, 1)]
    docs = [(i, " ".join(rng.choices(stems, [40, 30, 8, 9, 7, 6, 5, 4], k=40) + rng.choices(words, k=15))) for i in range(150)]
    docs += [(None, "Receive RECEIVE receive-receive receive"), (900, ("q" * 3000 + " ") * 6), (901, ("q" * 3001 + " ") * 40), (902, None), (903, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fed = df.union(nulled_docs.select("doc_id", "text")).union(df.filter("doc_id < 20")).withColumns({"word": F.lit(1), "n": F.lit("x")})
    plain = docs + [(r.doc_id, r.text) for r in nulled_docs.collect()] + docs[:20]
    got = group_spellings(fed, every=every).collect()
    assert len(got) == len({r.word for r in got}) and {tuple(r) for r in got} == _plain_spelling(plain, every)
    assert group_spellings(df.limit(0)).count() == 0


def test_spelling_chains(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    docs = [(i, " ".join([w] * 5 ** (i + 1))) for i, w in enumerate(chain)]
    got = {r.word: (r.form, r.root, r.n_near) for r in group_spellings(spark.createDataFrame(docs, "doc_id long, text string"), every=10**12).collect()}
    assert got == {w: (f, "aabbbb", n) for w, f, n in zip(chain, [*chain[1:], None], (1, 2, 2, 2, 1))}


def test_trie_slices_number_nodes_alike():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(300)})
    for cuts in ([0], [0, 40, 41, 150], list(range(0, len(words), 7))):
        borders, node = [words[c] for c in cuts], {}
        for s, c in enumerate(cuts):
            trie = TrieSlice(s, borders)
            for word in words[c : (cuts + [len(words)])[s + 1]]:
                for depth, number in enumerate(trie.path(word)):
                    assert node.setdefault(word[:depth], number) == number
        assert len(set(node.values())) == len(node) == len({w[:d] for w in words for d in range(len(w) + 1)})


def test_damage_is_that_of_the_rule():
    hit = defaultdict(list)
    for i in range(3000):
        hit[damaged(i, "straße", 199) == "straße"].append(i)
    assert len(hit[False]) == sum(zlib.crc32(f"{i}:straße".encode()) % 199 == 0 for i in range(3000)) > 0
    assert all(len(damaged(i, "straße", 199)) == 5 for i in hit[False])
    assert spelling.damaged(None, "abc", 1) == "abc"[: (h := zlib.crc32(b":abc") % 3)] + "abc"[h + 1 :]
