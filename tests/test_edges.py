"""Hand-made edge frames: dirty text, nulls, ties, sparse months, tiny inputs."""

import math
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyback.functions import columns as C
from tallyback.functions.tails import binomial_two_sided, gamma_upper_tail
from tallyback.operators import audit, joins
from tallyback.plans import anomalies as A
from tallyback.plans import baskets as B
from tallyback.plans import content as T
from tallyback.plans import models as M
from tallyback.plans import retention as N
from tallyback.plans import returns as R
from tallyback.plans import series as Y
from tallyback.sources import tables as S

SCHEMAS = {
    "orders": "order_id string, user_id string, order_date timestamp_ntz, order_status string, total_amount double",
    "order_items": "order_item_id string, order_id string, product_id string, user_id string, quantity double, item_price double, item_total double",
    "products": "product_id string, product_name string, category string, brand string, price double, rating double",
    "users": "user_id string, name string, email string, gender string, city string, signup_date timestamp_ntz",
    "reviews": "review_id string, order_id string, product_id string, user_id string, rating double, review_text string, review_date timestamp_ntz",
    "events": "event_id string, user_id string, product_id string, event_type string, event_timestamp timestamp_ntz",
}


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture
def make(spark):
    """Tables from row lists; the ones not given are empty."""

    def build(**rows):
        return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}

    return build


def one(df, **match):
    found = [r for r in df.collect() if all(r[k] == v for k, v in match.items())]
    assert len(found) == 1, found
    return found[0]


# ---------------------------------------------------------------- sources


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_cleaning(spark, tmp_path):
    csv = "product_id,product_name,category,brand,price,rating\n"
    cells = ["1.0d", " 2 ", "1e3", "NaN", "", "NA", "-.5", "0x10", "1_0"]
    for i, cell in enumerate(cells):
        csv += f"p{i}, name ,{'   ' if i == 0 else 'NA' if i == 1 else ' Toys '},b,{cell},4\n"
    raw = S.read_csv_table(spark, "products", write(tmp_path / "products.csv", csv))
    clean = S.clean_tables({"products": raw}, {})["products"]
    prices = [r.price for r in clean.orderBy("product_id").collect()]
    assert prices == [None, 2.0, 1000.0, None, None, None, -0.5, None, None]
    labels = [r.c for r in clean.orderBy("product_id").select(C.clean_label(F.col("category")).alias("c")).collect()]
    assert labels[:3] == ["Missing", "Missing", "Toys"]
    report = {r.column_name: r.unusable_cells for r in audit.coercion_audit({"products": clean}).collect()}
    assert report == {"price": 6, "rating": 0}
    assert S.keep_usable_rows({"products": clean.withColumn("category", F.lit("x"))})["products"].count() == 3


def test_timestamps_of_other_formats_become_null(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-05 10:00:00",), ("05/01/2024",), ("2024-13-01",), (None,)], "t string")
    got = [r.x for r in df.select(C.clean_timestamp(F.col("t"), "yyyy-MM-dd").alias("x")).collect()]
    assert got == [at("2024-01-05"), None, None, None, None]


def test_missing_column_is_refused(spark, tmp_path):
    path = write(tmp_path / "o.csv", "order_id,user_id,order_date,order_status\n1,2,3,4\n")
    with pytest.raises(ValueError, match="total_amount"):
        S.read_csv_table(spark, "orders", path)


def test_csv_columns_follow_the_header(spark, tmp_path):
    path = write(tmp_path / "o.csv", "total_amount,order_id,user_id,order_date,order_status,extra\n9.5,1,2,2024-01-01,returned,x\n")
    row = S.read_csv_table(spark, "orders", path).first()
    assert (row.order_id, row.total_amount, row.extra) == ("1", "9.5", "x")


def test_results_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    for fmt in ("parquet", "csv", "json"):
        S.write_table(df, str(tmp_path / fmt), fmt)
        back = spark.read.schema(df.schema).option("header", True).format(fmt).load(str(tmp_path / fmt))
        assert {(r.k, r.v) for r in back.collect()} == {("a", 1.5), ("b", None)}


def test_repeated_keys_are_counted_and_refused(make):
    order = ("o1", "u", at("2024-01-01"), "returned", 1.0)
    t = make(orders=[order, order, ("o1", "u", at("2024-01-02"), "returned", 2.0), ("o2", "u", None, None, None)])
    row = one(audit.source_audit(t), table_name="orders")
    assert (row.source_rows, row.exact_duplicate_rows, row.rows_after_exact_dedup, row.duplicate_keys_after_dedup) == (4, 1, 3, 1)
    quality = one(audit.file_quality(t), table_name="orders")
    assert (quality.null_cells, quality.rows_with_any_null, quality.repeated_key_extra_rows, quality.repeated_key_values) == (3, 1, 2, 1)
    with pytest.raises(ValueError, match="order_id"):
        S.require_unique_keys({"orders": t["orders"]})
    with pytest.raises(ValueError, match="order_id"):
        joins.join_checked(t["reviews"], t["orders"], "order_id", "inner", "many_to_one")


def test_empty_result_is_refused(spark):
    with pytest.raises(ValueError, match="nulls"):
        S.require_values(spark.createDataFrame([(None,)], "v double"), ["v"])


# ---------------------------------------------------------------- returns


def test_order_mart_edges(make):
    t = make(
        orders=[
            ("o1", "u1", at("2024-01-01T06:00"), "returned", 10.0),
            ("o2", None, at("2024-01-02"), None, None),
            ("o3", "u1", None, "Returned", 5.0),
            ("o4", "ghost", at("2024-02-03"), "returned", 7.0),
        ],
        order_items=[
            ("i1", "o1", "p1", "u1", None, 3.0, 3.0),
            ("i2", "o1", "p2", "u1", None, 4.0, 4.0),
            ("i3", "o4", None, "x", 2.0, 1.0, 2.0),
        ],
        products=[("p1", "n", "Toys", "Z", 1.0, 4.0), ("p2", "n", "Books", "A", 1.0, 5.0), (None, "n", "Null", "N", 1.0, 1.0)],
        users=[("u1", "n", "e", " ", "c", at("2024-01-02"))],
    )
    mart = {r.order_id: r for r in R.order_mart(t).collect()}
    assert len(mart) == 4
    o1, o2, o3, o4 = (mart[f"o{i}"] for i in range(1, 5))
    assert (o1.dominant_category, o1.dominant_brand) == ("Books", "A")  # ties to the smallest label
    assert o1.units is None and o1.item_count == 2 and o1.gender == "Missing"
    assert o1.tenure_days == pytest.approx(-0.75)
    assert (o1.order_sequence, o3.order_sequence, o2.order_sequence) == (1, 2, None)
    assert o2.sequence_group == "Missing" and o2.value_quintile == "Missing" and o2.returned == 0
    assert o3.returned == 0 and o3.month_name == "Missing" and o3.dominant_category == "Missing"
    assert o4.unmatched_product_lines == 1 and o4.dominant_category == "Missing"  # null never matches null
    assert {r.order_id: r.dominant_category for r in R.dominant_category_by_count(t).collect()} == {"o1": "Books", "o4": "Missing"}
    orphans = {r.link: r.orphan_rows for r in joins.foreign_key_orphans(t).collect()}
    assert orphans == {"orders_without_user": 2, "orders_without_items": 2, "items_without_order": 0, "items_without_product": 1, "reviews_without_order": 0}
    early = joins.orders_before_signup(t).first()
    assert (early.orders_before_signup, early.comparable_orders) == (1, 1)
    assert one(joins.owner_mismatches(t), link="item_user_differs").mismatched_rows == 1


def test_chi_square_known_values(spark):
    counts = spark.createDataFrame(
        [("two", "a", 30, 10), ("two", "b", 30, 20), ("single", "x", 9, 3), ("zeros", "a", 5, 0), ("zeros", "b", 6, 0)],
        "dimension string, level string, orders long, returned_orders long",
    )
    tests = R.with_p_values(R.chi_square(counts))
    two = one(tests, dimension="two")
    assert two.chi2 == pytest.approx(20 / 3) and two.degrees_freedom == 1 and two.orders_tested == 60
    assert two.cramers_v == pytest.approx(math.sqrt(20 / 3 / 60)) and two.p_value == pytest.approx(math.erfc(math.sqrt(10 / 3)), rel=1e-9)
    for name in ("single", "zeros"):
        row = one(tests, dimension=name)
        assert row.chi2 is None and row.p_value is None and row.degrees_freedom == 0 and row.expected_cell_count == 0


def test_tails_against_tables():
    for x, k, p in [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (6.634896601021214, 1, 0.01)]:
        assert gamma_upper_tail(k / 2, x / 2) == pytest.approx(p, rel=1e-9)
    assert binomial_two_sided(0, 0, 0.3) == 1.0
    for n in range(1, 25):
        for p in (0.2, 0.5, 0.77):
            pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
            for k in range(n + 1):
                want = min(1.0, sum(f for f in pmf if f <= pmf[k] * (1 + 1e-7)))
                assert binomial_two_sided(k, n, p) == pytest.approx(want, abs=1e-12)


def test_customers_without_orders(make):
    t = make(
        orders=[(f"o{i}", "u1", at("2024-01-01"), "returned" if i < 2 else "x", None if i == 0 else 4.0) for i in range(4)],
        users=[("u1", "", "", "", "", None), ("u2", "", "", "", "", None)],
    )
    found = {r.user_id: r for r in R.unusual_customers(R.binomial_returns_test(R.customer_returns(t))).collect()}
    assert (found["u1"].returned_order_value, found["u1"].returned_value_order_count, found["u1"].direction) == (4.0, 1, "At expectation")
    assert (found["u2"].customer_orders, found["u2"].returned_order_value, found["u2"].binomial_p_value) == (0, 0.0, 1.0)


def test_sparse_months(make):
    t = make(
        orders=[
            ("a", "u", at("2024-01-10"), "returned", 10.0),
            ("b", "u", at("2024-03-05"), "completed", 99.0),  # orders, nothing returned
            ("c", "u", at("2024-04-10"), "returned", 40.0),
            ("d", "u", at("2024-05-02"), "returned", 500.0),  # month not over
        ]
    )
    months = {r.month.strftime("%m"): r for r in R.months_on_spine(t).collect()}
    assert (months["02"].returned_order_count, months["02"].returned_order_value) == (0, 0.0)
    assert (months["03"].returned_order_count, months["03"].returned_order_value) == (0, None)
    rows = R.monthly_forecast(t).collect()
    forecast = [r for r in rows if r.period_status == "Forecast"]
    assert [r.month for r in forecast] == ["2024-06-01", "2024-07-01", "2024-08-01"]
    x, y = [0, 1, 3], [10.0, 0.0, 40.0]
    mx, my = sum(x) / 3, sum(y) / 3
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    assert forecast[0].forecast_order_value == pytest.approx(my + slope * (5 - mx))
    assert [r.included_in_trend_fit for r in rows if r.month == "2024-05-01"] == [False]
    single = make(orders=[("a", "u", at("2024-01-10"), "returned", 10.0)])
    with pytest.raises(PySparkException, match="fewer than two months"):
        R.monthly_forecast(single).collect()


# ---------------------------------------------------------------- retention


def test_early_orders_and_cohorts(make):
    t = make(
        orders=[("o1", "u", at("2024-01-01T12:00"), "x", 1.0), ("o2", "u", at("2024-03-02"), "x", 1.0)],
        users=[("u", "", "", "", "", at("2024-01-02")), ("late", "", "", "", "", at("2025-01-01"))],
    )
    found = {r.months_since_signup: r for r in N.cohort_retention(t).collect()}
    assert (found[0].active_users, found[0].orders_before_signup, found[0].cohort_size) == (1, 1, 1)
    assert set(found) == {0, 2} and found[2].retention == 1.0
    days = joins.orders_with_user(t).select(C.whole_days_clipped(F.col("order_date"), F.col("signup_date")).alias("d"))
    assert sorted(r.d for r in days.collect()) == [0, 60]


def brute_panel(orders, items, products, users, events, reviews, snapshots):
    category = {p[0]: (p[2], p[3]) for p in products}
    date = {o[0]: o[2] for o in orders}
    out = {}
    for snap in snapshots:
        for u in users:
            if u[5] > snap:
                continue
            past = [o for o in orders if o[1] == u[0] and o[2] < snap]
            if not past:
                continue
            lines = [i for i in items if i[3] == u[0] and i[1] in date and date[i[1]] < snap]
            kinds = [e[3].strip().lower() for e in events if e[1] == u[0] and e[4] < snap]
            rated = [r[4] for r in reviews if r[3] == u[0] and r[6] < snap]
            ahead = [o for o in orders if o[1] == u[0] and 0 <= (o[2] - snap).total_seconds() < 90 * 86400]
            out[u[0], snap] = (
                max(0, (snap - max(o[2] for o in past)).days),
                len(past),
                sum(i[4] for i in lines),
                len({i[2] for i in lines}),
                len({category[i[2]][0] for i in lines if i[2] in category and category[i[2]][0]}),
                len({category[i[2]][1] for i in lines if i[2] in category}),
                kinds.count("view"),
                len(rated),
                round(sum(r <= 2 for r in rated) / len(rated), 6) if rated else 0.0,
                (snap - u[5]).days,
                len(ahead),
                int(not ahead),
            )
    return out


def test_panel_matches_brute_force(make):
    orders = [(f"o{i}", f"u{i % 5}", datetime(2024, 1, 1 + (i * 7) % 28, i % 24), "x", float(i)) for i in range(30)]
    orders = [(o, u, d.replace(month=1 + (i * 5) % 12), s, a) for i, (o, u, d, s, a) in enumerate(orders)]
    orders += [("first", "u1", at("2024-01-01"), "x", 3.0), ("last", "u2", at("2024-12-31T15:00"), "x", 9.0)]
    products = [(f"p{i}", "n", None if i == 3 else f"c{i % 3}", f"b{i % 4}", 1.0, 1.0) for i in range(8)]
    items = [(f"i{i}", f"o{i % 32}", f"p{(i * 3) % 9}", f"u{i % 5}", float(1 + i % 3), 1.0, 1.0) for i in range(90)]
    users = [(f"u{i}", "", "", "", "", datetime(2023 + i % 2, 1 + 2 * i, 1)) for i in range(5)]
    events = [(f"e{i}", f"u{i % 5}", None, ["View", " view", "cart", "other"][i % 4], datetime(2024, 1 + i % 12, 3)) for i in range(40)]
    reviews = [(f"r{i}", "o1", "p1", f"u{i % 4}", float(1 + i % 5), "t", datetime(2024, 1 + (i * 5) % 12, 9)) for i in range(30)]
    t = make(orders=orders, order_items=items, products=products, users=users, events=events, reviews=reviews)
    calendar = N.snapshot_calendar(t["orders"])
    assert calendar.dates[0] == at("2024-03-31") and calendar.dates[-1] == at("2024-10-02") == calendar.final and calendar.extra_final
    assert [r.snapshot_date for r in N.snapshot_dates(t).collect()] == calendar.dates
    want = brute_panel(orders, items, products, users, events, reviews, calendar.dates)

    def shaped(panel):
        return {
            (r.user_id, r.snapshot_date): (
                r.recency_days, r.order_count, r.total_quantity, r.unique_products, r.category_breadth, r.brand_breadth, r.view_count,
                r.review_count, round(r.negative_review_share, 6), r.tenure_days, r.future_order_count, r.churn,
            )
            for r in panel.collect()
        }

    got = shaped(N.customer_snapshot_panel(t, calendar))
    assert got == want
    assert shaped(N.current_customers(t)) == {k: v for k, v in want.items() if k[1] == calendar.final}
    # the order on the last day, after midnight, is outside the final outcome window
    assert got["u2", calendar.final][10] == sum(1 for o in orders if o[1] == "u2" and calendar.final <= o[2] < at("2024-12-31"))
    direct = {(r.user_id, r.snapshot_date): r.order_count for r in N.history_before(t, calendar).collect()}
    assert all(direct[k] == v[1] for k, v in want.items())


def odd_facts(make):
    """Few users, one of them with most orders; null keys, labels, ratings and ids; products and reviews that are met again later."""
    orders = [(f"o{i}", None if i % 17 == 0 else f"u{0 if i % 3 else i % 4}", datetime(2024, 1 + (i * 5) % 12, 1 + i % 28), "x", None if i % 11 == 0 else float(i)) for i in range(60)]
    products = [(None if i == 5 else f"p{i}", "n", None if i == 3 else f"c{i % 3}", f"b{i % 4}", 1.0, 1.0) for i in range(8)]
    items = [(f"i{i}", f"o{i % 61}", None if i % 13 == 0 else f"p{i % 9}", None if i % 19 == 0 else orders[i % 60][1], None if i % 7 == 0 else 1.0 + i % 3, 1.0, 1.0) for i in range(200)]
    users = [(f"u{i}", "", "", "", "", datetime(2023, 1 + i, 1)) for i in range(4)]
    events = [(f"e{i}", f"u{i % 5}", None, ["view", "cart", "other"][i % 3], datetime(2024, 1 + i % 12, 3)) for i in range(40)]
    reviews = [(None if i % 9 == 0 else f"r{i % 21}", "o1", "p1", f"u{i % 4}", None if i % 8 == 0 else float(1 + i % 5), "t", datetime(2024, 1 + (i * 5) % 12, 9)) for i in range(60)]
    return make(orders=orders, order_items=items, products=products, users=users, events=events, reviews=reviews)


def test_panel_deals_hot_users_out(make, monkeypatch):
    t = odd_facts(make)
    whole = sorted(map(str, N.customer_snapshot_panel(t).collect()))
    monkeypatch.setattr(N, "HOT_ORDERS", 10)
    assert N._hot_users(t["orders"]) == ["u0"]
    assert sorted(map(str, N.customer_snapshot_panel(t).collect())) == whole


def test_panel_facts_meet_once_per_user(spark, folder):
    """Lines and reviews are moved to their user once; neither labels nor sums nor the running sums move them again."""
    from tallyback.sources.mapped import load_tables

    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = load_tables(spark, folder)
        plan = N.customer_snapshot_panel(t, N.snapshot_calendar(t["orders"]))._jdf.queryExecution().executedPlan().toString()
        rollup = A.anomaly_rollup(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [m for m in moves if "label" in m or "review_id#" in m.split("hashpartitioning(")[1].split(")")[0]]
    assert sum("lineitem.parquet" in line for line in plan.splitlines()) == 2  # once for the items, once for the reviews
    assert "hashpartitioning(order_id" in rollup and not [x for x in rollup.splitlines() if "Exchange" in x and "order_item_id#" in x.split("ENSURE")[0]]


def test_short_history_has_one_snapshot(make):
    t = make(orders=[("a", "u", at("2024-01-01"), "x", 1.0), ("b", "u", at("2024-04-20"), "x", 1.0)])
    assert N.snapshot_calendar(t["orders"]).dates == [at("2024-01-21")]
    assert [r.snapshot_date for r in N.snapshot_dates(t).collect()] == [at("2024-01-21")]


def test_embargo_drops_late_training_dates():
    calendar = N.SnapshotCalendar(tuple(datetime(2024, m, 1) for m in range(1, 11)), datetime(2024, 10, 1))
    train, test = N.temporal_split(calendar)
    assert (len(train), len(test)) == (8, 2)
    short, _ = N.temporal_split(calendar, embargo_days=90)
    assert short == [d for d in train if (test[0] - d).days >= 90] and len(short) == 6


def test_segment_rules(spark):
    rows = [(10, 3, "Champions"), (91, 2, "At-risk"), (181, 1, "Lost"), (181, 2, "At-risk"), (50, 1, "One-time"), (50, 2, "Core"), (30, 2, "Core"), (91, 1, "One-time")]
    df = spark.createDataFrame(rows, "r int, o int, want string")
    assert df.filter(N.rfm_segment(F.col("r"), F.col("o")) != F.col("want")).count() == 0


def test_basket_rules_by_hand(spark):
    baskets = {f"o{i}": ["a", "b"] for i in range(30)} | {f"x{i}": ["a", "c"] for i in range(25)} | {f"s{i}": ["a"] for i in range(9)} | {"r": ["b", "d"]}
    labels = spark.createDataFrame([(o, v) for o, vs in baskets.items() for v in vs], "order_id string, label string")
    rules = {(r.antecedent, r.consequent): r for r in B.basket_rules(labels, "l").collect()}
    assert set(rules) == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
    r = rules["a", "b"]
    assert (r.co_orders, r.min_co_orders) == (30, 20)
    assert r.support == pytest.approx(30 / 56) and r.confidence == pytest.approx(30 / 55) and r.lift == pytest.approx((30 / 55) / (31 / 56))


def test_similar_products_are_exact_for_any_rare_limit(make):
    words = ["red", "blue", "oak", "tin", "cup", "jar"]
    products = [(f"p{i:02d}", f"{words[i % 6]} {words[(i * i) % 5]}", f"cat{i % 3}", f"brand{i % 4}", 1.0, 1.0) for i in range(40)]
    t = make(products=products)
    full = {(r.seed_product_id, r.similarity_rank): (r.similar_product_id, round(r.similarity, 7)) for r in T.content_similarity(t, rare_limit=10**6).collect()}
    assert len(full) == 120
    for limit in (0, 3, 8):
        got = {(r.seed_product_id, r.similarity_rank): (r.similar_product_id, round(r.similarity, 7)) for r in T.content_similarity(t, rare_limit=limit).collect()}
        assert got == full, limit


def test_recommendations_fill_up_from_popular(make):
    products = [("p1", "lamp", "home", "acme", 1.0, 1.0)] + [(f"q{i}", f"thing{i}", f"kind{i}", f"maker{i}", 1.0, 1.0) for i in range(5)]
    orders = [("o1", "u", at("2024-01-01"), "x", 1.0), ("o2", "v", at("2024-01-02"), "x", 1.0), ("o9", "v", at("2024-12-31"), "x", 1.0)]
    items = [("i1", "o1", "p1", "u", 1.0, 1.0, 1.0)] + [(f"j{i}", "o2", f"q{i}", "v", 1.0, 1.0, 1.0) for i in range(5)]
    users = [("u", "", "", "", "", at("2023-01-01")), ("v", "", "", "", "", at("2023-01-01"))]
    t = make(products=products, orders=orders, order_items=items, users=users)
    found = [r for r in T.content_recommendations(t, N.current_customers(t)).collect()]
    mine = sorted((r.recommendation_rank, r.recommended_product_id, r.source) for r in found if r.user_id == "u")
    assert mine == [(1, "q0", "popular"), (2, "q1", "popular"), (3, "q2", "popular")]
    assert [(r.recommended_product_id, r.source) for r in found if r.user_id == "v"] == [("p1", "popular")]  # all else is bought


def test_seasonal_naive_short_and_long(spark):
    def run(values, horizon):
        rows = [("s", datetime(2024, 1, 1 + i).date(), float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "series string, day date, revenue double")
        return [r.forecast for r in Y.seasonal_naive(df, horizon).orderBy("step").collect()]

    assert run([1, 2, 3, 4, 5, 6, 7, 8, 9], 9) == [3, 4, 5, 6, 7, 8, 9, 3, 4]
    assert run([1, 2, 3], 8) == [3, 3, 3, 3, 1, 2, 3, 3]


def test_smoothing_recovers_a_clean_season(spark):
    rows = [("s", datetime(2024, 1, 1).toordinal() + i, 100.0 + 2 * i + 10 * (i % 7)) for i in range(70)]
    df = spark.createDataFrame(rows, "series string, n int, revenue double").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n") - F.lit(rows[0][1])))
    got = [r.forecast for r in Y.smoothing(df, 14, ["Holt-Winters weekly"]).orderBy("step").collect()]
    assert got == pytest.approx([100.0 + 2 * i + 10 * (i % 7) for i in range(70, 84)], rel=0.01)


def test_robust_z_falls_back_when_spread_is_zero(spark):
    columns = A.FOREST_INPUTS
    rows = [(f"o{i}", *([1.0] * len(columns))) for i in range(9)] + [("odd", *([50.0] * len(columns))), ("none", *([None] * len(columns)))]
    df = spark.createDataFrame(rows, "order_id string, " + ", ".join(f"{c} double" for c in columns))
    flags = {r.order_id: r.robust_z_flag for r in A.order_robust_z(df).collect()}
    assert flags["odd"] == 1 and flags["none"] == 0 and sum(flags.values()) == 1


def test_unflagged_orders_have_no_reason(spark):
    df = spark.createDataFrame([(0, 0, "none"), (1, 0, "robust_z_only"), (0, 1, "isolation_forest_only"), (1, 1, "both_methods")], "r int, f int, want string")
    assert df.filter(A.flag_reason(F.col("r"), F.col("f")) != F.col("want")).count() == 0


def test_auc_and_metrics_of_known_scores(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.6)], "label int, score double")
    row = M.classifier_metrics(scored, "label", "score").first()
    assert row.roc_auc == pytest.approx((2.5 + 1) / 6)
    assert (row.precision, row.recall, row.f1) == (pytest.approx(1 / 3), 0.5, pytest.approx(0.4))
    one_class = M.classifier_metrics(scored.filter("label = 0"), "label", "score").first()
    assert one_class.roc_auc is None and one_class.precision == 0.0


def test_oversampling_keeps_labels_with_rows(spark):
    df = spark.createDataFrame([(str(i), int(i % 10 == 0), float(i % 10 == 0)) for i in range(1000)], "k string, label int, x double")
    out = M.balanced_oversample(df, "k", "label")
    assert out.filter("label <> x").count() == 0
    a, b = (r["count"] for r in out.groupBy("label").count().collect())
    assert a == pytest.approx(b, rel=0.05)


def test_shuffled_labels_keep_the_class_counts(spark):
    df = spark.createDataFrame([(str(i), int(i < 300)) for i in range(1000)], "k string, label int")
    out = M.shuffled_labels(df, "k")
    assert out.count() == 1000 and out.agg(F.sum("label")).first()[0] == 300
    agree = df.withColumnRenamed("label", "was").join(out, "k").filter("was = label").count()
    assert agree == pytest.approx(580, abs=60)


def test_products_against_chance(make):
    t = make(
        orders=[{"order_id": f"o{i}", "user_id": "u1", "order_status": "returned" if i < 10 else "completed"} for i in range(40)],
        order_items=[
            *[{"order_item_id": f"a{i}", "order_id": f"o{i}", "product_id": "bad"} for i in range(10)],
            *[{"order_item_id": f"b{i}", "order_id": f"o{i}", "product_id": "good"} for i in range(8, 12)],
            {"order_item_id": "again", "order_id": "o0", "product_id": "bad"},
            {"order_item_id": "none", "order_id": "o1", "product_id": None},
            {"order_item_id": "orphan", "order_id": "unknown", "product_id": "lost"},
        ],
    )
    found = {r.product_id: r for r in R.unusual_products(t).collect()}
    assert set(found) == {"bad", "good"}
    assert (found["bad"].product_orders, found["bad"].product_returns, found["bad"].expected_returns) == (10, 10, 2.5)
    assert found["bad"].unusual and found["bad"].direction == "Above expectation"
    assert found["good"].binomial_p_value == pytest.approx(binomial_two_sided(2, 4, 0.25)) and not found["good"].unusual
    figures = {r.metric: r.value for r in R.product_binomial_summary(R.unusual_products(t)).collect()}
    assert (figures["Products tested"], figures["Unusual products"], figures["Unusual products above expectation"]) == (2, 1, 1)


def test_unlike_rows(spark):
    """Multisets compared by digests and then by rows: copies, nulls against empty text and swapped columns count."""
    from tallyback.sources.tables import unlike_rows

    kind = "a string, b string"
    rows = [("x", "1"), ("x", "1"), (None, "2"), ("", "2"), ("3", None)]
    left = spark.createDataFrame(rows, kind)
    assert unlike_rows(left, spark.createDataFrame(rows[::-1], kind)) == 0
    assert unlike_rows(left, spark.createDataFrame(rows[1:], kind)) == 1
    assert unlike_rows(left, spark.createDataFrame([("x", "1"), ("x", "1"), ("", "2"), ("", "2"), (None, "3")], kind)) == 4
    assert unlike_rows(left, spark.createDataFrame([], kind)) == 5


def test_spread_rows(spark):
    """A fit's rows are dealt out over all cores, whatever table they come from; a few rows stay as they lie."""
    from pyspark.ml.functions import array_to_vector

    from tallyback.plans import models as M

    rows = spark.range(0, M.SPREAD_ROWS + 1, 1, 1).select("id", array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    dealt = M.spread(rows, "id")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt.count() == M.SPREAD_ROWS + 1
    assert M.spread(rows.limit(10), "id").count() == 10


def test_nearest_rows_reads_few_boxes():
    """Boxes that can't hold a neighbour are left out, with the neighbours, ties and order of a full search."""
    import numpy as np

    from tallyback.operators import neighbours

    rng = np.random.default_rng(3)
    points = rng.integers(0, 60, (6000, 3)).astype(float)
    queries = rng.integers(0, 60, (400, 3)).astype(float)
    found = neighbours.boxes(points)
    assert sorted(found.order) == list(range(len(points))) and len(found.borders) > 20
    for query, (near, distances) in zip(queries, neighbours.nearest_rows(queries, points, 9, found)):
        far = np.sqrt(((points - query) ** 2).sum(1))
        order = np.lexsort((np.arange(len(points)), far))[:9]
        assert (near == order).all() and (distances == far[order]).all()


def test_items_move_once_to_their_orders(spark, folder):
    """Items come with their owner laid out by order_id, so that a join with the orders does not move them again."""
    from tallyback.sources.mapped import load_tables

    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = load_tables(spark, folder)
        joined = t["order_items"].select("order_id", "user_id", "quantity").join(t["orders"].select("order_id", "order_date"), "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 3  # items, owners, orders


def test_candidates_are_fitted_side_by_side_and_once(spark, monkeypatch):
    """All fits have begun before any ends, and the fitted ones are kept for scoring."""
    import threading

    begun, fits = threading.Barrier(3, timeout=60), []

    def fit(train, candidate, key):
        fits.append(candidate.name)
        begun.wait()
        return lambda asked: asked.select(key, "label", F.lit(0.5).alias("score"))

    monkeypatch.setattr(M, "fitted_scorer", fit)
    rows = spark.createDataFrame([(str(i), i % 2) for i in range(6)], "id string, label int")
    metrics = M.evaluate(rows, rows, [M.Candidate(n, None) for n in "abc"], "id")
    assert sorted(r.model for r in metrics.collect()) == ["a", "b", "c"] == sorted(fits)
    assert metrics.fitted["a"](rows).count() == 6
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_shuffles_get_partitions_by_the_rows_of_the_tables(spark, folder, monkeypatch):
    from tallyback import catalog_base, session

    monkeypatch.setattr(session, "ROWS_PER_PART", 100)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, seen = [spark.conf.get(k) for k in keys], []

    def build(t):
        seen.append((int(spark.conf.get(keys[0])), t["order_items"].count()))
        return t["products"]

    catalog_base.on_tables(build)(spark, folder)
    ((parts, rows),) = seen
    assert parts == math.ceil(rows / 100) > int(before[0])
    with pytest.raises(ZeroDivisionError), session.shuffles_for(spark.range(10_000)):
        1 / 0  # noqa: B018
    assert [spark.conf.get(k) for k in keys] == before


def test_recommendations_read_deep_lists_only_for_users_who_bought_the_first(spark, monkeypatch):
    """Buyers of the first 2 top products go down to their reach, others don't; results are those of the whole lists."""
    ranked = spark.createDataFrame([(1, f"p{i:02d}", 1.0 - i / 100, i + 1) for i in range(30)], "seed long, product_id string, similarity double, rank int")
    users = spark.createDataFrame([("deep", "Core", "p00", 1, 23), ("near", "Core", "p00", 1, 4), ("few", "Core", "p00", 1, 2)],
                                  "user_id string, segment string, seed_product_id string, seed long, reach long")
    bought = spark.createDataFrame([("deep", f"p{i:02d}") for i in range(20) if i != 4] + [("near", "p00")], "user_id string, product_id string")
    asked, unseen = [], T.unseen_candidates

    def watched(candidates, purchases):
        asked.append(candidates.count())
        return unseen(candidates, purchases)

    monkeypatch.setattr(T, "unseen_candidates", watched)
    found = T.first_unbought(users, ranked, bought, 3).collect()
    got = {u: [r.product_id for r in sorted(found, key=lambda r: r.recommendation_rank) if r.user_id == u] for u in ("deep", "near", "few")}
    assert got == {"deep": ["p04", "p20", "p21"], "near": ["p01", "p02", "p03"], "few": ["p00", "p01"]}
    assert asked == [6 + 4 + 2, 23 + 2]


def test_forest_in_level_order_scores_like_its_nodes():
    import numpy as np
    from tallyback.operators import forest

    tree = [np.array(x) for x in ([1, -1, 0, -1, -1], [0.5, 0.0, 2.0, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 1.25, 0.0, 2.5, 3.5])]
    leaf = [np.array(x) for x in ([-1], [0.0], [-1], [-1], [4.0])]
    data = np.array([[9.0, 0.5], [2.0, 0.6], [2.1, 0.6], [-np.inf, np.inf], [np.inf, -np.inf], [np.nan, np.nan]])
    levels = forest.level_order(*tree)
    assert levels[0] == 2 and len(levels[1]) == 3
    assert forest.total_depth([levels, forest.level_order(*leaf)], data).tolist() == [5.25, 6.5, 7.5, 6.5, 5.25, 7.5]
