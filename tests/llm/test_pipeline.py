"""The pipeline against a plain version of every stage on its own input, and what stages return on odd rows."""

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from tallyback.llm.bpe import parse_ranks
from tallyback.llm.pu_quality import score_quality
from tallyback.llm.sql import _MIX
from tests.llm.test_groups import grams, roots


def lines_dropped(rows, least=5):
    sites = {}
    for _, text, source in rows:
        for line in text.split("\n"):
            sites.setdefault(line.strip(" \t\n\x0b\x0c\r"), set()).add(source)
    wide = {line for line, found in sites.items() if line and len(found) >= least}
    return [(d, "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in wide), s) for d, t, s in rows]


def test_stages_against_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"
    ]
    seen, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{len(seen)}")
        now = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(now)
        if name != "byte-level BPE":
            assert now.columns == docs.columns
    take = lambda df: sorted((r.doc_id, r.text, r.source) for r in df.collect())

    good = {r.doc_id for r in score_quality(docs, labels).filter("predicted = 1").collect()}
    assert take(seen[0]) == [r for r in take(docs) if r[0] in good]
    assert take(seen[1]) == lines_dropped(take(seen[0]))
    assert all(r.n_chars == len(r.text) for r in seen[1].collect())

    sets = {d: grams(t) for d, t, _ in take(seen[1])}
    by_gram = {}
    for d, s in sets.items():
        for g in s:
            by_gram.setdefault(g, []).append(d)
    pairs = {(a, b) for found in by_gram.values() for a in found for b in found if a < b}
    root = roots(sets, [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert take(seen[2]) == [r for r in take(seen[1]) if root[r[0]] == r[0]]

    con = duckdb.connect()
    con.execute(f"CREATE VIEW kept AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    copies = dict(con.execute("WITH " + _MIX.replace("{docs}", "kept") + " SELECT doc_id, copies FROM copies").fetchall())
    assert take(seen[3]) == sorted(r for r in take(seen[2]) for _ in range(copies.get(r[0], 0)))

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(lines), special_tokens={})
    want = sorted((d, " ".join(map(str, encoding.encode_ordinary(t)))) for d, t, _ in take(seen[3]))
    assert sorted((r.doc_id, r.ids) for r in seen[4].collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, seen[4].collect()))


def test_stages_on_odd_rows(spark, odd_docs, nulled_docs, folder):
    for docs in (odd_docs, nulled_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert (out.columns == docs.columns or name == "byte-level BPE") and out.count() <= 3 * docs.count()


def test_near_copy_stage_keeps_rows_without_id_and_one_of_repeated_rows(spark, nulled_docs, folder):
    got = corpus_pipeline.keep_one_of_near_copies(spark, nulled_docs, folder)
    assert got.columns == nulled_docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 8, 9]
