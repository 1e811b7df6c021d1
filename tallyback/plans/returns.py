"""Why are orders returned: order mart, segment rates, association tests, customers, months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyback.functions import columns as C
from tallyback.functions.tails import binomial_p_values, chi_square_upper_tail
from tallyback.operators.joins import (
    foreign_key_orphans,
    items_with_product,
    orders_before_signup,
    orders_with_user,
    owner_mismatches,
    reviews_with_status,
)
from tallyback.operators.quantiles import exact_quantile
from tallyback.operators.ranks import global_row_number, row_number_by_day
from tallyback.operators.sizing import settle
from tallyback.sources.tables import Tables, union_all

# Labels of the five order-value bins, lowest first.
QUINTILE_LABELS = ["Q1 lowest", "Q2", "Q3", "Q4", "Q5 highest"]

# Display order of dimension levels that have a natural order.
LEVEL_ORDER = {
    "Order-value quintile": QUINTILE_LABELS + [C.MISSING],
    "Month of year": [
        "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
        "December", C.MISSING,
    ],
    "Day of week": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", C.MISSING],
    "Customer order sequence": ["1st", "2nd", "3rd", "4+", C.MISSING],
}

# The eight tested dimensions and their mart columns.
SEGMENT_COLUMNS = {
    "Dominant product category": "dominant_category",
    "Dominant brand": "dominant_brand",
    "Order-value quintile": "value_quintile",
    "Items per order": "item_count",
    "Gender": "gender",
    "Month of year": "month_name",
    "Day of week": "day_name",
    "Customer order sequence": "sequence_group",
}


# ---------------------------------------------------------------- order mart


def order_item_rollup(t: Tables) -> DataFrame:
    """One row per order from its item lines."""
    return (
        items_with_product(t)
        .filter("order_id IS NOT NULL")
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.sum("quantity").alias("units"),
            F.max("item_price").alias("max_price"),
            F.avg("product_rating").alias("avg_product_rating"),
            F.mode("category", True).alias("dominant_category"),
            F.mode("brand", True).alias("dominant_brand"),
            F.count_if(~F.col("product_matched")).alias("unmatched_product_lines"),
        )
    )


def dominant_labels(t: Tables) -> DataFrame:
    """Most frequent category and brand per order, ties to the smallest label."""
    return (
        items_with_product(t)
        .filter("order_id IS NOT NULL")
        .groupBy("order_id")
        .agg(
            F.mode("category", True).alias("dominant_category"),
            F.mode("brand", True).alias("dominant_brand"),
        )
    )


def dominant_category_by_count(t: Tables) -> DataFrame:
    """The same category by a count table and its first row: an independent route to ``dominant_labels``."""
    counts = (
        items_with_product(t)
        .filter("order_id IS NOT NULL")
        .groupBy("order_id", "category")
        .agg(F.count(F.lit(1)).alias("item_lines"))
    )
    best = F.min(F.struct((-F.col("item_lines")).alias("neg_lines"), "category")).alias("best")
    return counts.groupBy("order_id").agg(best).select(
        "order_id", F.col("best.category").alias("dominant_category"), (-F.col("best.neg_lines")).alias("item_lines")
    )


def orders_with_rollup(t: Tables) -> DataFrame:
    return t["orders"].join(order_item_rollup(t), "order_id", "left")


def order_sequence(orders: DataFrame) -> DataFrame:
    """Position of each order among its user's orders by (date, order id); null without a user."""
    return row_number_by_day(orders, "user_id", "order_date", "order_id", "order_sequence")


def sequence_group(n: Column) -> Column:
    return (
        F.when(n.isNull(), C.MISSING).when(n == 1, "1st").when(n == 2, "2nd").when(n == 3, "3rd").otherwise("4+")
    )


def order_value_quintile(orders: DataFrame) -> DataFrame:
    """Five bins of (almost) equal count per order amount; ties go in (user, date, order id) order."""
    order_by = [
        F.col("total_amount"),
        F.col("user_id").asc_nulls_last(),
        F.col("order_date").asc_nulls_last(),
        F.col("order_id"),
    ]
    valued = orders.select("order_id", "user_id", "order_date", "total_amount").filter("total_amount IS NOT NULL")
    numbered = global_row_number(valued, order_by, "amount_rank").select("order_id", "amount_rank")
    total = numbered.agg(F.max("amount_rank")).scalar()
    # bin of 1-based rank r among n: ceil(5 (r - 1) / (n - 1)), at least 1, in whole numbers
    steps = F.greatest(total - 1, F.lit(1))
    bucket = F.greatest(F.lit(1), F.floor((5 * (F.col("amount_rank") - 1) + steps - 1) / steps))
    return numbered.select(
        "order_id",
        bucket.cast("int").alias("value_bucket"),
        F.element_at(F.array(*map(F.lit, QUINTILE_LABELS)), bucket.cast("int")).alias("value_quintile"),
    )


def date_parts(ts: Column) -> dict[str, Column]:
    return {
        "order_month": C.month_start(ts),
        "month_name": F.coalesce(F.date_format(ts, "MMMM"), F.lit(C.MISSING)),
        "day_name": F.coalesce(F.date_format(ts, "EEEE"), F.lit(C.MISSING)),
    }


def order_mart(t: Tables) -> DataFrame:
    """One row per order with every feature of the returns study."""
    sequenced = order_sequence(orders_with_user(t))
    return (
        sequenced.join(order_item_rollup(t), "order_id", "left")
        .join(order_value_quintile(t["orders"]), "order_id", "left")
        .withColumns(
            {
                "returned": C.returned_flag(F.col("order_status")),
                "return_status": C.return_label(C.returned_flag(F.col("order_status"))),
                "dominant_category": F.coalesce("dominant_category", F.lit(C.MISSING)),
                "dominant_brand": F.coalesce("dominant_brand", F.lit(C.MISSING)),
                "value_quintile": F.coalesce("value_quintile", F.lit(C.MISSING)),
                "tenure_days": C.days_between(F.col("order_date"), F.col("signup_date")),
                "sequence_group": sequence_group(F.col("order_sequence")),
                **date_parts(F.col("order_date")),
            }
        )
    )


def order_mart_export(mart: DataFrame) -> DataFrame:
    """The published order table: dates as ISO text, labels never null."""
    return mart.select(
        "order_id",
        "user_id",
        "order_status",
        "return_status",
        "returned",
        F.date_format("order_date", "yyyy-MM-dd'T'HH:mm:ss").alias("order_date"),
        F.date_format("order_month", "yyyy-MM-dd").alias("order_month"),
        "total_amount",
        "item_count",
        "units",
        "max_price",
        "avg_product_rating",
        "dominant_category",
        "dominant_brand",
        "gender",
        "tenure_days",
        "order_sequence",
        "sequence_group",
        "value_quintile",
        F.col("day_name").alias("day_of_week"),
    )


def category_returns(t: Tables) -> DataFrame:
    """Order id, dominant category and returned flag; orders without items are ``Missing``."""
    flags = t["orders"].select("order_id", C.returned_flag(F.col("order_status")).alias("returned"))
    labels = dominant_labels(t).select("order_id", "dominant_category")
    return flags.join(labels, "order_id", "left").select(
        "order_id", F.coalesce("dominant_category", F.lit(C.MISSING)).alias("dominant_category"), "returned"
    )


def category_return_table(t: Tables) -> DataFrame:
    return (
        category_returns(t)
        .groupBy("dominant_category")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("returned").alias("returned_orders"),
            F.avg("returned").alias("return_rate"),
        )
    )


# ---------------------------------------------------------------- KPIs


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Long (metric, value) rows out of one global aggregate."""
    keys = [f"m{i}" for i in range(len(metrics))]
    entries = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(k).cast("double").alias("value")) for k, n in zip(keys, metrics)]
    )
    return df.agg(*[expr.alias(k) for k, expr in zip(keys, metrics.values())]).select(F.inline(entries))


def _overall_metrics() -> dict[str, Column]:
    amount, returned = F.col("total_amount"), C.returned_flag(F.col("order_status"))
    returned_value = F.sum(F.when(returned == 1, amount))
    return {
        "Orders": F.count(F.lit(1)),
        "Returned orders": F.sum(returned),
        "Overall return rate": F.avg(returned),
        "Total order value": F.sum(amount),
        "Returned order value": returned_value,
        "Returned value share": C.ratio(returned_value, F.sum(amount)),
        "Non-returned order value": F.sum(F.when(returned == 0, amount)),
        "Orders with usable total_amount": F.count(amount),
    }


def overall_kpis(t: Tables) -> DataFrame:
    return metric_rows(t["orders"], _overall_metrics())


def _two_base_metrics() -> dict[str, Column]:
    kept = F.coalesce(F.lower("order_status") != "cancelled", F.lit(True))
    flag = C.returned_flag(F.col("order_status"))
    return {
        "Return rate, all orders": F.avg(flag),
        "Return rate, orders not cancelled": F.avg(F.when(kept, flag)),
    }


def return_rate_two_bases(t: Tables) -> DataFrame:
    """Return rate over all orders and over orders that were not cancelled."""
    return metric_rows(t["orders"], _two_base_metrics())


def value_concentration(t: Tables, thresholds: list[float]) -> DataFrame:
    """Share of returned orders and of returned value above each amount."""
    amount = F.col("total_amount")
    returned = t["orders"].filter(F.col("order_status") == "returned")
    totals = []
    for i, limit in enumerate(thresholds):
        above = amount > F.lit(float(limit))
        totals += [F.count_if(above).alias(f"n{i}"), F.sum(F.when(above, amount).otherwise(0.0)).alias(f"v{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(limit)).alias("amount_above"),
                F.col(f"n{i}").alias("returned_orders"),
                C.ratio(F.col(f"n{i}").cast("double"), F.col("n")).alias("order_share"),
                C.ratio(F.col(f"v{i}"), F.col("v")).alias("value_share"),
            )
            for i, limit in enumerate(thresholds)
        ]
    )
    return returned.agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("v"), *totals).select(F.inline(rows))


def _lost_metrics() -> dict[str, Column]:
    amount, status = F.col("total_amount"), F.lower("order_status")
    lost = F.sum(F.when(status.isin("returned", "cancelled"), amount))
    return {"Gross order value": F.sum(amount), "Lost value": lost, "Lost value share": C.ratio(lost, F.sum(amount))}


def lost_value_share(t: Tables) -> DataFrame:
    """Returned plus cancelled value over gross order value."""
    return metric_rows(t["orders"], _lost_metrics())


# ---------------------------------------------------------------- segments and tests


def segment_counts(mart: DataFrame) -> DataFrame:
    """Orders and returned orders per (dimension, level) for all dimensions in one pass.

    Each order becomes one narrow row per dimension, which the map-side
    aggregate folds into a few hundred (dimension, level) rows before the shuffle.
    """
    levels = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING)).alias("level"))
            for d, c in SEGMENT_COLUMNS.items()
        ]
    )
    return (
        mart.select("returned", F.inline(levels))
        .groupBy("dimension", "level")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("returned").alias("returned_orders"))
    )


def segment_return_rates(mart: DataFrame) -> DataFrame:
    return segment_counts(mart).withColumn("return_rate", F.col("returned_orders") / F.col("orders"))


def level_position(dimension: Column, level: Column) -> Column:
    """Sort key of a level: its place in the natural order, or its number, or null."""
    position = level.try_cast("double")
    for name, order in LEVEL_ORDER.items():
        place = F.nullif(F.array_position(F.array(*map(F.lit, order)), level), F.lit(0))
        position = F.when(dimension == name, place.cast("double")).otherwise(position)
    return position


def ordered_segments(rates: DataFrame) -> DataFrame:
    return rates.withColumn("level_position", level_position(F.col("dimension"), F.col("level"))).orderBy(
        "dimension", F.col("level_position").asc_nulls_last(), "level"
    )


def contingency(df: DataFrame, level: str, flag: str, zero: str, one: str) -> DataFrame:
    """Level by 0/1 counts; a missing column counts 0 and empty levels do not appear."""
    return df.groupBy(level).agg(F.count_if(F.col(flag) == 0).alias(zero), F.count_if(F.col(flag) == 1).alias(one))


def chi_square(counts: DataFrame) -> DataFrame:
    """Pearson chi-square, Cramér's V and sparse-cell counts per dimension.

    ``counts`` holds dimension, level, orders, returned_orders. Column totals
    are one row per tested dimension, a fixed handful, and are sent to all
    tasks; levels are only summed, so a dimension may have any number of them.
    """
    totals = F.broadcast(
        counts.groupBy("dimension").agg(
            F.sum("orders").alias("n"),
            F.sum("returned_orders").alias("n1"),
            F.count(F.lit(1)).alias("levels"),
        )
    )
    share = F.col("n1") / F.col("n")
    e1, e0 = F.col("orders") * share, F.col("orders") * (1 - share)
    o1 = F.col("returned_orders")
    o0 = F.col("orders") - o1
    usable = (F.col("levels") >= 2) & (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
    summed = (
        counts.join(totals, "dimension")
        .groupBy("dimension")
        .agg(
            F.first("n").alias("orders_tested"),
            F.first("levels").alias("levels"),
            F.first(usable).alias("usable"),
            F.sum(C.ratio((o0 - e0) * (o0 - e0), e0) + C.ratio((o1 - e1) * (o1 - e1), e1)).alias("chi2"),
            F.sum((e0 < 5).cast("int") + (e1 < 5).cast("int")).alias("low"),
        )
    )
    def guarded(value: Column, other: Column) -> Column:
        return F.when(F.col("usable"), value).otherwise(other)

    return summed.select(
        "dimension",
        guarded(F.col("chi2"), F.lit(None).cast("double")).alias("chi2"),
        guarded(F.col("levels") - 1, F.lit(0)).alias("degrees_freedom"),
        guarded(F.sqrt(F.col("chi2") / F.col("orders_tested")), F.lit(None).cast("double")).alias("cramers_v"),
        "orders_tested",
        guarded(F.col("low"), F.lit(0)).alias("expected_cells_below_5"),
        guarded(F.col("levels") * 2, F.lit(0)).alias("expected_cell_count"),
        guarded(F.col("low") / (F.col("levels") * 2), F.lit(None).cast("double")).alias("pct_expected_cells_below_5"),
    )


def with_p_values(tests: DataFrame) -> DataFrame:
    """Upper-tail p-value per test row (a handful of rows)."""
    tail = F.pandas_udf(chi_square_upper_tail, "double")
    return tests.withColumn("p_value", tail(F.col("chi2"), F.col("degrees_freedom").cast("double")))


def tested_segments(mart: DataFrame) -> DataFrame:
    """Return rate per level of the eight order dimensions, each row with the test of its dimension.

    The counts are written once and give both the rows and the tests.
    """
    counts = settle(segment_counts(mart))
    tests = with_p_values(chi_square(counts)).select("dimension", "chi2", "p_value", "cramers_v")
    rates = counts.withColumn("return_rate", F.col("returned_orders") / F.col("orders"))
    return rates.join(F.broadcast(tests), "dimension")  # one row per tested dimension


def with_bonferroni(tests: DataFrame) -> DataFrame:
    """p-value times the number of usable tests, at most 1. One row per test, so the bare window is tiny."""
    everything = Window.partitionBy()
    return tests.withColumn("bonferroni_p", F.least(F.lit(1.0), F.col("p_value") * F.count("p_value").over(everything)))


def review_counts(reviews: DataFrame, column: str, dimension: str) -> DataFrame:
    return reviews.groupBy(F.col(column).alias("level")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("returned").alias("returned_orders")
    ).select(F.lit(dimension).alias("dimension"), "level", "orders", "returned_orders")


def rated_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with a usable rating, labelled with one decimal."""
    return reviews.filter("rating IS NOT NULL").withColumn("rating_label", F.format_string("%.1f", F.col("rating")))


def association_counts(t: Tables, mart: DataFrame) -> DataFrame:
    """Counts for all ten tested attributes: eight order dimensions, review text and review rating."""
    reviews = reviews_with_status(t)
    return union_all(
        [
            segment_counts(mart),
            review_counts(reviews, "review_text", "Review text (exact normalized labels)"),
            review_counts(rated_reviews(reviews), "rating_label", "Review rating"),
        ]
    )


def association_tests(t: Tables, mart: DataFrame) -> DataFrame:
    return chi_square(association_counts(t, mart))


def review_summary(t: Tables) -> DataFrame:
    """Per return status: review rows, orders, mean, count and exact median rating."""
    reviews = reviews_with_status(t)
    basics = reviews.groupBy("return_status").agg(
        F.count(F.lit(1)).alias("review_rows"), F.avg("rating").alias("avg_rating"), F.count("rating").alias("rating_count")
    )
    order_counts = reviews.select("return_status", "order_id").distinct().groupBy("return_status").agg(
        F.count("order_id").alias("orders_with_review")
    )
    medians = exact_quantile(reviews, F.col("rating"), 0.5, ["return_status"], "median_rating")
    return basics.join(order_counts, "return_status").join(medians, "return_status", "left").select(
        "return_status", "review_rows", "orders_with_review", "avg_rating", "rating_count", "median_rating"
    )


def _distribution(df: DataFrame, column: str, name: str) -> DataFrame:
    table = contingency(df, column, "returned", "non_returned_review_rows", "returned_review_rows")
    total = F.col("non_returned_review_rows") + F.col("returned_review_rows")
    return table.select(
        F.col(column).alias(name),
        "non_returned_review_rows",
        "returned_review_rows",
        total.alias("total_review_rows"),
        (F.col("returned_review_rows") / total).alias("return_rate"),
    )


def review_text_distribution(t: Tables) -> DataFrame:
    return _distribution(reviews_with_status(t), "review_text", "review_text")


def review_rating_distribution(t: Tables) -> DataFrame:
    return _distribution(rated_reviews(reviews_with_status(t)), "rating_label", "rating")


# ---------------------------------------------------------------- customers


def customer_returns(t: Tables) -> DataFrame:
    """Per listed user: orders, returns, expected returns and returned value; zeros without orders."""
    flag = C.returned_flag(F.col("order_status"))
    orders = t["orders"].withColumn("returned", flag)
    pooled = orders.agg(F.avg("returned")).scalar()
    valued = F.when(F.col("returned") == 1, F.col("total_amount"))
    per_user = (
        orders.filter("user_id IS NOT NULL")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("customer_orders"),
            F.sum("returned").alias("customer_returns"),
            F.sum(valued).alias("returned_order_value"),
            F.count(valued).alias("returned_value_order_count"),
        )
    )
    zero = F.lit(0).cast("bigint")
    joined = t["users"].select("user_id").distinct().join(per_user, "user_id", "left")
    returns = F.coalesce("customer_returns", zero)
    return joined.select(
        "user_id",
        F.coalesce("customer_orders", zero).alias("customer_orders"),
        returns.alias("customer_returns"),
        (F.coalesce("customer_orders", zero) * pooled).alias("expected_returns"),
        F.when(returns == 0, F.lit(0.0)).otherwise(F.col("returned_order_value")).alias("returned_order_value"),
        F.coalesce("returned_value_order_count", zero).alias("returned_value_order_count"),
        pooled.alias("pooled_rate"),
    )


def binomial_test(df: DataFrame, trials: str, successes: str, rate: str) -> DataFrame:
    """Exact two-sided p-value per row.

    Only distinct (trials, successes) pairs are evaluated; their number follows
    the spread of the counts, not the number of rows, and is measured
    before the pairs are sent to the tasks.
    """
    p_value = F.pandas_udf(binomial_p_values, "double")
    pairs = df.select(trials, successes, rate).distinct()
    tested = settle(pairs.select(trials, successes, p_value(successes, trials, rate).alias("binomial_p_value")))
    return df.join(tested, [trials, successes])


def binomial_returns_test(customers: DataFrame) -> DataFrame:
    return binomial_test(customers, "customer_orders", "customer_returns", "pooled_rate")


def product_returns(t: Tables) -> DataFrame:
    """Per product bought: orders that hold it, how many were returned, and how many chance alone would return."""
    flag = C.returned_flag(F.col("order_status"))
    orders = t["orders"].select("order_id", flag.alias("returned"))
    pooled = orders.agg(F.avg("returned")).scalar()
    held = t["order_items"].filter("product_id IS NOT NULL").select("order_id", "product_id").distinct()
    counts = held.join(orders, "order_id").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("product_orders"), F.sum("returned").alias("product_returns")
    )
    return counts.withColumns({"expected_returns": F.col("product_orders") * pooled, "pooled_rate": pooled})


def unusual_products(t: Tables, limit: float = 0.01) -> DataFrame:
    """Products tested against the pooled return rate, as customers are."""
    tested = binomial_test(product_returns(t), "product_orders", "product_returns", "pooled_rate")
    return _against_chance(tested, "product_returns", limit).drop("pooled_rate")


def product_binomial_summary(products: DataFrame, limit: float = 0.01) -> DataFrame:
    """Flagged products beside the number that chance alone would flag at most."""
    above = F.col("direction") == "Above expectation"
    return metric_rows(
        products,
        {
            "Products tested": F.count(F.lit(1)),
            "Unusual products": F.count_if("unusual"),
            "Unusual products above expectation": F.count_if(F.col("unusual") & above),
            "Unusual products below expectation": F.count_if(F.col("unusual") & (F.col("direction") == "Below expectation")),
            "Unusual products by chance, at most": F.count(F.lit(1)) * F.lit(limit),
            "Smallest p-value": F.min("binomial_p_value"),
            "Bonferroni p-value of the smallest": F.least(F.lit(1.0), F.min("binomial_p_value") * F.count(F.lit(1))),
        },
    )


def _against_chance(tested: DataFrame, observed: str, limit: float = 0.01) -> DataFrame:
    seen, expected = F.col(observed), F.col("expected_returns")
    return tested.withColumns(
        {
            "unusual": F.col("binomial_p_value") < limit,
            "direction": F.when(seen > expected, "Above expectation").when(seen < expected, "Below expectation").otherwise("At expectation"),
        }
    )


def unusual_customers(tested: DataFrame) -> DataFrame:
    return _against_chance(tested, "customer_returns")


def customer_binomial_summary(unusual: DataFrame) -> DataFrame:
    high = F.col("unusual") & (F.col("direction") == "Above expectation")
    low = F.col("unusual") & (F.col("direction") == "Below expectation")
    value = F.col("returned_order_value")
    return metric_rows(
        unusual,
        {
            "Listed customers": F.count(F.lit(1)),
            "Customers with linked orders": F.count_if(F.col("customer_orders") > 0),
            "Orders linked to listed users": F.sum("customer_orders"),
            "Pooled return probability": F.max("pooled_rate"),
            "Expected returns among linked customers": F.sum("expected_returns"),
            "Observed returns among linked customers": F.sum("customer_returns"),
            "Unusual customers": F.count_if("unusual"),
            "Unusual customers above expectation": F.count_if(high),
            "Returned value for unusual customers": F.coalesce(F.sum(F.when(F.col("unusual"), value)), F.lit(0.0)),
            "Returned value for unusual customers above expectation": F.coalesce(F.sum(F.when(high, value)), F.lit(0.0)),
            "Unusual customers below expectation": F.count_if(low),
        },
    )


# ---------------------------------------------------------------- months


def monthly_returns(t: Tables) -> DataFrame:
    """Per month with orders: returned count and returned value (null when nothing came back)."""
    flag = C.returned_flag(F.col("order_status"))
    return (
        t["orders"]
        .filter("order_date IS NOT NULL")
        .groupBy(C.month_start(F.col("order_date")).alias("month"))
        .agg(
            F.sum(flag).alias("returned_order_count"),
            F.sum(F.when(flag == 1, F.col("total_amount"))).alias("returned_order_value"),
            F.max("order_date").alias("last_order"),
        )
    )


def months_on_spine(t: Tables) -> DataFrame:
    """Every month from first to last, empty ones with zeros, numbered from 0. One row per calendar month."""
    monthly = monthly_returns(t)
    ends = monthly.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.max("last_order").alias("last_order"))
    spine = ends.select(
        F.posexplode(F.sequence("first_month", "last_month", F.expr("interval 1 month"))).alias("month_index", "month"),
        "last_month",
        "last_order",
    )
    known = monthly.select("month", "returned_order_count", "returned_order_value", F.lit(True).alias("_known"))
    zero_if_absent = F.col("_known").isNull()
    partial = (F.col("month") == F.col("last_month")) & (F.dayofmonth("last_order") < F.dayofmonth(F.last_day("last_order")))
    return spine.join(known, "month", "left").select(
        "month",
        "month_index",
        F.when(zero_if_absent, F.lit(0)).otherwise(F.col("returned_order_count")).alias("returned_order_count"),
        F.when(zero_if_absent, F.lit(0.0)).otherwise(F.col("returned_order_value")).alias("returned_order_value"),
        partial.alias("partial_month"),
    )


def monthly_forecast(t: Tables, horizon: int = 3, full_months_only: bool = True) -> DataFrame:
    """Straight-line trend of returned orders and value, projected ``horizon`` months, never below zero.

    With ``full_months_only`` a last month that is not over yet stays out of
    the fit. Months whose value is null (orders, none returned) are skipped by
    the value fit. Fewer than two fitted months is an error.
    """
    months = months_on_spine(t)
    in_fit = ~F.col("partial_month") if full_months_only else F.lit(True)
    x = F.when(in_fit, F.col("month_index").cast("double"))
    enough = F.count_if(in_fit) >= 2
    fit = months.agg(
        F.when(enough, F.max("month")).otherwise(F.raise_error(F.lit("fewer than two months to fit"))).alias("last_month"),
        F.max("month_index").alias("last_index"),
        F.regr_slope(F.col("returned_order_count").cast("double"), x).alias("count_slope"),
        F.regr_intercept(F.col("returned_order_count").cast("double"), x).alias("count_base"),
        F.regr_slope("returned_order_value", x).alias("value_slope"),
        F.regr_intercept("returned_order_value", x).alias("value_base"),
    )
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.col("last_index") + F.col("step")

    def line(base: str, slope: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(base) + F.col(slope) * at)

    nothing = F.lit(None).cast("double")
    actual = months.select(
        F.date_format("month", "yyyy-MM-dd").alias("month"),
        F.when(F.col("partial_month"), "Actual (partial month)").otherwise("Actual (full month)").alias("period_status"),
        F.col("returned_order_count").cast("double").alias("returned_order_count"),
        "returned_order_value",
        nothing.alias("forecast_order_count"),
        nothing.alias("forecast_order_value"),
        in_fit.alias("included_in_trend_fit"),
    )
    future = ahead.select(
        F.date_format(F.add_months("last_month", F.col("step")), "yyyy-MM-dd").alias("month"),
        F.lit("Forecast").alias("period_status"),
        nothing.alias("returned_order_count"),
        nothing.alias("returned_order_value"),
        line("count_base", "count_slope").alias("forecast_order_count"),
        line("value_base", "value_slope").alias("forecast_order_value"),
        F.lit(False).alias("included_in_trend_fit"),
    )
    return actual.unionByName(future)


# ---------------------------------------------------------------- scorecard and decisions


def value_route(t: Tables, low: float = 25.0, high: float = 1000.0) -> DataFrame:
    """Returned orders with the handling route their value calls for."""
    amount = F.col("total_amount")
    route = (
        F.when(amount.isNull(), "Review amount")
        .when(amount < low, "Refund without collection")
        .when(amount > high, "Inspect and exchange first")
        .otherwise("Standard return")
    )
    return t["orders"].filter(F.col("order_status") == "returned").select("order_id", "user_id", "total_amount", route.alias("route"))


def link_checks(t: Tables) -> DataFrame:
    """The checks that follow keys from one table to another."""
    orphans = foreign_key_orphans(t).select(
        F.col("link").alias("check_name"), F.col("orphan_rows").alias("failing_rows"), F.col("child_rows").alias("denominator")
    )
    mismatches = owner_mismatches(t).select(
        F.col("link").alias("check_name"), F.col("mismatched_rows").alias("failing_rows"), F.col("linked_rows").alias("denominator")
    )
    early = orders_before_signup(t).select(
        F.lit("orders_before_signup").alias("check_name"),
        F.col("orders_before_signup").alias("failing_rows"),
        F.col("comparable_orders").alias("denominator"),
    )
    return union_all([orphans, mismatches, early])


def linkage_checks(t: Tables) -> DataFrame:
    """The ten link and parse checks with their denominators."""
    rows = F.array(
        F.struct(F.lit("order_amount_unusable").alias("check_name"), F.col("bad_amount").alias("failing_rows"), F.col("n").alias("denominator")),
        F.struct(F.lit("order_date_unusable").alias("check_name"), F.col("bad_date").alias("failing_rows"), F.col("n").alias("denominator")),
    )
    unusable = t["orders"].agg(
        F.count_if(F.col("total_amount").isNull()).alias("bad_amount"),
        F.count_if(F.col("order_date").isNull()).alias("bad_date"),
        F.count(F.lit(1)).alias("n"),
    ).select(F.inline(rows))
    return union_all([link_checks(t), unusable])


def returns_scorecard(t: Tables, mart: DataFrame, thresholds: list[float]) -> DataFrame:
    """One (metric, value) table: KPIs, both return rates, lost value, concentration, checks, test strength.

    Everything that is a figure of the orders alone comes from one aggregate over them.
    """
    amount, returned = F.col("total_amount"), F.col("order_status") == "returned"
    returned_value = F.sum(F.when(returned, amount))
    shares = {
        f"Share of returned value above {limit:.0f}": C.ratio(
            F.sum(F.when(returned, F.when(amount > F.lit(float(limit)), amount).otherwise(0.0))), returned_value
        )
        for limit in thresholds
    }
    unusable = {
        "Check: order_amount_unusable": F.count_if(amount.isNull()),
        "Check: order_date_unusable": F.count_if(F.col("order_date").isNull()),
    }
    links = link_checks(t).select(
        F.concat(F.lit("Check: "), "check_name").alias("metric"), F.col("failing_rows").cast("double").alias("value")
    )
    strength = chi_square(segment_counts(mart)).agg(F.max("cramers_v").alias("value")).select(
        F.lit("Strongest segment association (Cramer's V)").alias("metric"), "value"
    )
    figures = _overall_metrics() | _two_base_metrics() | _lost_metrics() | shares | unusable
    return union_all([metric_rows(t["orders"], figures), links, strength])


def cost_benefit_scenarios(t: Tables, scenarios: list[tuple[str, float, float, float]]) -> DataFrame:
    """Expected value of a programme per scenario and the cut in the return rate that pays for it.

    Each scenario is (name, points cut from the return rate, share of a saved
    order's value kept, programme cost). The scenario list is the caller's and short.
    """
    flag = C.returned_flag(F.col("order_status"))
    totals = t["orders"].agg(
        F.count(F.lit(1)).alias("orders"), F.avg(F.when(flag == 1, F.col("total_amount"))).alias("value_per_return")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("scenario"), F.lit(float(p)).alias("points_cut"), F.lit(float(m)).alias("value_kept"), F.lit(float(c)).alias("cost")
            )
            for n, p, m, c in scenarios
        ]
    )
    value_per_point = F.col("orders") * 0.01 * F.col("value_per_return") * F.col("value_kept")
    return totals.select("orders", "value_per_return", F.inline(rows)).select(
        "scenario",
        (F.col("points_cut") * value_per_point).alias("value_saved"),
        (F.col("points_cut") * value_per_point - F.col("cost")).alias("net_value"),
        C.ratio(F.col("cost"), value_per_point).alias("break_even_points"),
    )
