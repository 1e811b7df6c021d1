"""As-of totals against a plain loop."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tallyback.operators.asof import totals_before

START = datetime(2024, 1, 1)
FACTS, POINTS = "k string, ts timestamp_ntz, amount double", "k string, ts timestamp_ntz, tag string"


def plain(facts, points):
    for k, ts, tag in points:
        hits = [a for fk, ft, a in facts if fk == k and ft is not None and ts is not None and ft < ts]
        yield k, ts, tag, len(hits), round(sum(a for a in hits if a is not None), 6)


def found(spark, facts, points):
    sums = {"n": F.lit(1).cast("bigint"), "total": F.col("amount")}
    known, asked = spark.createDataFrame(facts, FACTS).repartition(5), spark.createDataFrame(points, POINTS).repartition(3)
    out = totals_before(known, asked, "k", "ts", sums)
    assert out.columns == ["k", "ts", "tag", "n", "total"]
    return sorted(((r.k, r.ts, r.tag, r.n, round(r.total, 6)) for r in out.collect()), key=repr)


def test_totals_before_match_a_loop(spark):
    rng = np.random.default_rng(3)

    def moment():
        return START + timedelta(hours=int(rng.integers(0, 240)))  # many ties between facts and points

    keys = ["hot"] * 8 + ["a", "b", None]
    facts = [(keys[rng.integers(len(keys))], moment(), float(rng.integers(0, 90))) for _ in range(600)]
    points = [(keys[rng.integers(len(keys))], moment(), str(i)) for i in range(150)]
    assert found(spark, facts, points) == sorted(plain(facts, points), key=repr)


def test_totals_before_on_odd_rows(spark):
    noon = START + timedelta(hours=12)
    facts = [("a", noon, 1.0), ("a", noon, 1.0), ("a", None, 5.0), ("a", START, None), (None, START, 2.0)]
    points = [("a", noon, "tie"), ("a", noon + timedelta(microseconds=1), "after"), ("a", START - timedelta(days=400), "early"),
              ("a", START + timedelta(days=900), "late"), ("a", START + timedelta(days=900), "late"), ("new", noon, None),
              (None, noon, "null key"), ("a", None, "no time")]
    assert found(spark, facts, points) == sorted(plain(facts, points), key=repr)
    assert found(spark, [], points) == sorted(plain([], points), key=repr)
    assert found(spark, facts, []) == []
