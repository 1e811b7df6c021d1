"""Customer retention: enriched facts, landscape, cohorts, snapshot panel, segments."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyback.functions import columns as C
from tallyback.operators.asof import totals_before
from tallyback.operators.ranks import first_row_per_key, percent_ranks
from tallyback.sources.tables import Tables

# Engagement event types, and the panel features in model order.
ENGAGEMENT_TYPES = ["view", "cart", "wishlist"]
FEATURES = [
    "recency_days", "order_count", "total_spend_log1p", "avg_order_value_log1p", "total_quantity", "unique_products",
    "category_breadth", "brand_breadth", "view_count", "cart_count", "wishlist_count", "review_count",
    "avg_review_rating", "negative_review_share", "tenure_days",
]

OUTCOME_DAYS = 90
STEP_DAYS = 30


# ---------------------------------------------------------------- enriched facts


def product_dimension(t: Tables) -> DataFrame:
    """One row per product; a repeated id keeps its first row by name, category, brand and price."""
    dims = t["products"].withColumn("price_log1p", C.log1p_floor_zero(F.col("price")))
    return first_row_per_key(dims, "product_id", ["product_name", "category", "brand", "price"])


def enriched_items(t: Tables) -> DataFrame:
    """Items with product attributes, price ratio, line gap and order date."""
    dims = product_dimension(t).select("product_id", "category", "brand", F.col("price").alias("catalogue_price"))
    dates = t["orders"].select("order_id", "order_date")
    line_total = F.col("quantity") * F.col("item_price")
    return (
        t["order_items"]
        .join(dims, "product_id", "left")
        .join(dates, "order_id", "left")
        .withColumns(
            {
                "price_ratio": C.ratio(F.col("item_price"), F.col("catalogue_price")),
                "line_total": line_total,
                "line_gap": F.col("item_total") - line_total,
            }
        )
    )


def order_breadth_rollup(t: Tables) -> DataFrame:
    """Per order: distinct lines, products, categories and brands, sums and price ratios.

    Lines first fold to one row per (order, product), where products need no distinct
    count any more and the few labels of an order fit in a set.
    """
    dims = product_dimension(t).select("product_id", "category", "brand", F.col("price").alias("catalogue_price"))
    ratio = C.ratio(F.col("item_price"), F.col("catalogue_price"))
    per_product = (
        t["order_items"]
        .join(dims, "product_id", "left")
        .groupBy("order_id", "product_id", "category", "brand")
        .agg(
            F.count_distinct("order_item_id").alias("lines"),
            F.sum("quantity").alias("quantity"),
            F.sum("item_total").alias("item_total"),
            F.max("item_price").alias("max_item_price"),
            F.sum(ratio).alias("ratio_sum"),
            F.count(ratio).alias("ratio_count"),
            F.max(ratio).alias("max_ratio"),
        )
    )
    return per_product.groupBy("order_id").agg(
        F.sum("lines").alias("item_line_count"),
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_quantity"),
        F.coalesce(F.sum("item_total"), F.lit(0.0)).alias("item_total_sum"),
        F.count("product_id").alias("unique_products"),
        F.size(F.collect_set("category")).cast("long").alias("category_breadth"),
        F.size(F.collect_set("brand")).cast("long").alias("brand_breadth"),
        F.max("max_item_price").alias("max_item_price"),
        C.ratio(F.sum("ratio_sum"), F.sum("ratio_count").cast("double")).alias("mean_price_ratio"),
        F.max("max_ratio").alias("max_price_ratio"),
    )


def reconciled_orders(t: Tables) -> DataFrame:
    """Order amount against the sum of its items."""
    sums = t["order_items"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_line_count"), F.coalesce(F.sum("item_total"), F.lit(0.0)).alias("item_total_sum")
    )
    gap = F.col("total_amount") - F.col("item_total_sum")
    return t["orders"].join(sums, "order_id", "left").select(
        "order_id", "total_amount", "item_line_count", "item_total_sum", gap.alias("item_total_gap"), F.abs(gap).alias("item_total_gap_abs")
    )


def reconciliation_summary(t: Tables) -> DataFrame:
    over = F.col("item_total_gap_abs") > 0.01
    return reconciled_orders(t).agg(
        F.count("item_line_count").alias("orders_with_items"),
        F.count_if(over).alias("orders_with_gap_over_one_cent"),
        F.avg(F.coalesce(over.cast("int"), F.lit(0))).alias("gap_rate"),
    )


# ---------------------------------------------------------------- landscape


def revenue_share(t: Tables, level: str) -> DataFrame:
    """Item revenue of valid orders per category or brand, and its share. Nulls are a level of their own."""
    dims = product_dimension(t).select("product_id", level)
    revenue = (
        t["order_items"]
        .join(t["orders"].select("order_id"), "order_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum("item_total").alias("revenue"))
        .join(dims, "product_id", "left")
        .groupBy(level)
        .agg(F.sum("revenue").alias("revenue"))
    )
    return revenue.withColumn("share", F.col("revenue") / revenue.agg(F.sum("revenue")).scalar())


def top_levels(shares: DataFrame, level: str, n: int) -> DataFrame:
    return shares.orderBy(F.desc("revenue"), level).limit(n)


def engagement_events(t: Tables) -> DataFrame:
    """View, cart and wishlist events, type in lower case."""
    kind = F.lower(F.trim("event_type"))
    return t["events"].withColumn("event_type", kind).filter(kind.isin(ENGAGEMENT_TYPES))


def engagement_reach(t: Tables) -> DataFrame:
    """Distinct users per engagement type, and distinct buyers."""
    buyers = t["orders"].agg(F.count_distinct("user_id").alias("unique_users"))
    return (
        engagement_events(t)
        .groupBy("event_type")
        .agg(F.count_distinct("user_id").alias("unique_users"))
        .unionByName(buyers.select(F.lit("ordered_user").alias("event_type"), "unique_users"))
    )


def user_cohorts(t: Tables) -> DataFrame:
    """Signup month of every user who signed up by the last order day."""
    last_day = t["orders"].agg(F.date_trunc("day", F.max("order_date")).cast("timestamp_ntz")).scalar()
    return t["users"].filter(F.col("signup_date") <= last_day).select(
        "user_id", "signup_date", F.date_format("signup_date", "yyyy-MM").alias("cohort_month")
    )


def cohort_sizes(t: Tables) -> DataFrame:
    return user_cohorts(t).groupBy("cohort_month").agg(F.count_distinct("user_id").alias("cohort_size"))


def cohort_orders(t: Tables, months: int = 12) -> DataFrame:
    """Orders with their 30-day month since signup (0 to ``months``); earlier orders count in month 0."""
    joined = t["orders"].select("user_id", "order_date").join(user_cohorts(t), "user_id")
    since = F.greatest(F.lit(0), F.floor(F.floor(C.days_between(F.col("order_date"), F.col("signup_date"))) / STEP_DAYS))
    early = (F.col("order_date") < F.col("signup_date")).cast("int")
    return joined.select("user_id", "cohort_month", since.alias("months_since_signup"), early.alias("before_signup")).filter(
        F.col("months_since_signup").between(0, months)
    )


def cohort_retention(t: Tables) -> DataFrame:
    """Active users per cohort and month, their share of the cohort, and how many orders predate signup.

    Orders fold to one row per (cohort, month, user) before the distinct count,
    so one busy user or one busy month does not weigh on a task.
    """
    active = (
        cohort_orders(t)
        .groupBy("cohort_month", "months_since_signup", "user_id")
        .agg(F.sum("before_signup").alias("early"))
        .groupBy("cohort_month", "months_since_signup")
        .agg(F.count("user_id").alias("active_users"), F.sum("early").alias("orders_before_signup"))
    )
    return active.join(cohort_sizes(t), "cohort_month", "left").withColumn(
        "retention", F.col("active_users") / F.col("cohort_size")
    )


def cohort_matrix(t: Tables, months: int = 12) -> DataFrame:
    return (
        cohort_retention(t).groupBy("cohort_month").pivot("months_since_signup", list(range(months + 1))).agg(F.first("retention"))
        .select("cohort_month", *[F.col(str(m)).alias(f"month_{m}") for m in range(months + 1)])
    )


def user_status_rates(t: Tables) -> DataFrame:
    status = F.col("order_status")
    return t["orders"].groupBy("user_id").agg(
        F.avg(C.status_is(status, "cancelled")).alias("cancelled_rate"),
        F.avg(C.status_is(status, "returned")).alias("returned_rate"),
    )


# ---------------------------------------------------------------- snapshots


@dataclass(frozen=True)
class SnapshotCalendar:
    """A regular grid of snapshot dates and, when it is off the grid, one final date."""

    grid: tuple[datetime, ...]
    final: datetime

    @property
    def dates(self) -> list[datetime]:
        return sorted({*self.grid, self.final})

    @property
    def extra_final(self) -> bool:
        return self.final not in self.grid

    def index_of_next(self, ts: Column) -> Column:
        """1-based number of the first snapshot after ``ts``; null after the last one."""
        size, last = len(self.grid), len(self.dates)
        index = F.lit(None).cast("int")
        if self.extra_final:
            index = F.when(ts < F.lit(self.final).cast("timestamp_ntz"), F.lit(last))
        if size:
            first = F.lit(self.grid[0]).cast("timestamp_ntz")
            on_grid = (F.greatest(F.lit(-1), F.floor(C.days_between(ts, first) / STEP_DAYS)) + 2).cast("int")
            index = F.when(on_grid <= size, on_grid).otherwise(index)
        return index

    def indexes_before(self, ts: Column) -> Column:
        """Numbers of all snapshots s with s <= ts < s + 90 days (at most four)."""
        size, last = len(self.grid), len(self.dates)
        parts = []
        if size:
            days = C.days_between(ts, F.lit(self.grid[0]).cast("timestamp_ntz"))
            high = F.least(F.lit(size), F.floor(days / STEP_DAYS) + 1).cast("int")
            low = F.greatest(F.lit(1), F.floor((days - OUTCOME_DAYS) / STEP_DAYS) + 2).cast("int")
            parts.append(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))
        if self.extra_final:
            final = F.lit(self.final).cast("timestamp_ntz")
            days = C.days_between(ts, final)
            inside = (days >= 0) & (days < OUTCOME_DAYS)
            parts.append(F.when(inside, F.array(F.lit(last))).otherwise(F.array().cast("array<int>")))
        return F.concat(*parts)

    def date_at(self, index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(d).cast("timestamp_ntz") for d in self.dates]), index)


def snapshot_calendar(orders: DataFrame) -> SnapshotCalendar:
    """Every 30 days from the first order day + 90 to the last order day - 90, and that last date itself.

    One row (first and last order) reaches the driver, so the dates are
    literals and date filters are pushed into the scans.
    """
    bounds = orders.agg(F.min("order_date").alias("a"), F.max("order_date").alias("b")).first()
    if bounds.a is None:
        raise ValueError("no dated orders, so there are no snapshots")
    first = datetime(bounds.a.year, bounds.a.month, bounds.a.day) + timedelta(days=OUTCOME_DAYS)
    final = datetime(bounds.b.year, bounds.b.month, bounds.b.day) - timedelta(days=OUTCOME_DAYS)
    count = (final - first).days // STEP_DAYS + 1 if first <= final else 0
    return SnapshotCalendar(tuple(first + timedelta(days=STEP_DAYS * i) for i in range(count)), final)


def snapshot_dates(t: Tables) -> DataFrame:
    """The same dates as a declarative frame: sequence, union, distinct."""
    day = F.expr("interval 1 day")
    ends = t["orders"].agg(
        (F.date_trunc("day", F.min("order_date")).cast("timestamp_ntz") + day * OUTCOME_DAYS).alias("first"),
        (F.date_trunc("day", F.max("order_date")).cast("timestamp_ntz") - day * OUTCOME_DAYS).alias("final"),
    )
    grid = F.when(F.col("first") <= F.col("final"), F.sequence("first", "final", F.expr("interval 30 days")))
    return ends.select(F.explode(grid).alias("snapshot_date")).union(ends.select("final")).distinct().orderBy("snapshot_date")


# Running measures of the panel and the fact that feeds each.
_RUNNING = [
    "order_count", "total_spend", "total_quantity", "unique_products", "category_breadth", "brand_breadth", "view_count",
    "cart_count", "wishlist_count", "review_count", "rating_sum", "rating_rows", "negative_reviews",
]
_OUTCOME = ["future_order_count", "future_spend"]
_MEASURES = _RUNNING + _OUTCOME


HOT_ORDERS = 250_000  # a user with more orders than this is dealt to several tasks
HOT_PARTS = 64


def _deltas(facts: DataFrame, **measures: Column) -> DataFrame:
    """One fact table summed per (user, snapshot number), in the common shape (user, snapshot number, measures, last order).

    It is summed with its own measures only: rows of all measures would be moved once per fact where users are many.
    """
    own = facts.filter("user_id IS NOT NULL AND snapshot_no IS NOT NULL").groupBy("user_id", "snapshot_no")
    last = measures.pop("last_order_date", None)
    sums = [F.sum(value.cast("double")).alias(m) for m, value in measures.items()]
    return _in_shape(own.agg(*sums, *([] if last is None else [F.max(last).alias("last_order_date")])))


def _in_shape(part: DataFrame) -> DataFrame:
    last = F.col("last_order_date") if "last_order_date" in part.columns else F.lit(None).cast("timestamp_ntz").alias("last_order_date")
    zero = F.lit(0.0)
    return part.select("user_id", "snapshot_no", *[(F.col(m).cast("double") if m in part.columns else zero).alias(m) for m in _MEASURES], last)


def _hot_users(orders: DataFrame) -> list[str]:
    """Users with so many orders that one task can't hold their facts; there is one per ``HOT_ORDERS`` orders at most."""
    found = orders.filter("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("orders"))
    return [r.user_id for r in found.filter(F.col("orders") > HOT_ORDERS).select("user_id").collect()]


def _first_met(facts: DataFrame, met: list[Column], spread_by: str, hot: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (user, kind, label): the first snapshot and the sums; ``met`` are structs of kind and label, null labels are left out.

    A user's facts are brought together once and all kinds are told apart there. Those of hot users are spread by another
    column and merged in a second step.
    """
    facts = facts.filter("user_id IS NOT NULL AND snapshot_no IS NOT NULL")
    keys = ["user_id", "kind", "label"]
    values = {"snapshot_no": F.min, **dict.fromkeys(sums, F.sum)}

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*[how(c).alias(c) for c, how in values.items()])

    def told_apart(rows: DataFrame, *more: str) -> DataFrame:
        added = [value.cast("double").alias(m) for m, value in sums.items()]
        return rows.select("user_id", *more, "snapshot_no", *added, F.inline(F.array(*met))).filter("label IS NOT NULL")

    if not hot:
        return merged(told_apart(facts.repartition("user_id")), *keys)
    part = F.when(F.col("user_id").isin(hot), F.pmod(F.xxhash64(spread_by), F.lit(HOT_PARTS))).otherwise(F.lit(0))
    dealt = facts.withColumn("_part", part).repartition("user_id", "_part")
    return merged(merged(told_apart(dealt, "_part"), *keys, "_part"), *keys)


def _kind(name: str, label: Column) -> Column:
    return F.struct(F.lit(name).alias("kind"), label.cast("string").alias("label"))


def snapshot_deltas(t: Tables, calendar: SnapshotCalendar) -> DataFrame:
    """What each user added before each snapshot, summed per (user, snapshot number).

    Every fact is read once and lands in exactly one snapshot, the first after
    it. Distinct products, categories, brands and reviews become additive by
    counting only the first time a user meets each of them. Plain sums go by
    kind ``at``, whose label is the snapshot itself.
    """
    one = F.lit(1.0)
    orders = t["orders"].withColumn("snapshot_no", calendar.index_of_next(F.col("order_date")))
    order_part = _deltas(orders, order_count=one, total_spend=F.col("total_amount"), last_order_date=F.col("order_date"))

    outcome = t["orders"].withColumn("snapshot_no", F.explode(calendar.indexes_before(F.col("order_date"))))
    outcome_part = _deltas(outcome, future_order_count=one, future_spend=F.col("total_amount"))

    def is_kind(name: str) -> Column:
        return F.col("kind") == name

    def at(measure: str) -> Column:
        return F.sum(F.when(is_kind("at"), F.col(measure)))

    hot = _hot_users(t["orders"])
    by_snapshot = _kind("at", F.col("snapshot_no"))
    dims = product_dimension(t).select("product_id", "category", "brand")
    numbered = orders.filter("snapshot_no IS NOT NULL").select("order_id", "snapshot_no")
    items = t["order_items"].select("order_id", "user_id", "product_id", "quantity").join(numbered, "order_id")
    labelled = items.drop("order_id").join(dims, "product_id", "left")
    kinds = [by_snapshot, _kind("product", F.col("product_id")), _kind("category", F.col("category")), _kind("brand", F.col("brand"))]
    bought = _first_met(labelled, kinds, "product_id", hot, {"quantity": F.col("quantity")})
    item_part = _in_shape(
        bought.groupBy("user_id", "snapshot_no").agg(
            at("quantity").alias("total_quantity"),
            F.count_if(is_kind("product")).alias("unique_products"),
            F.count_if(is_kind("category")).alias("category_breadth"),
            F.count_if(is_kind("brand")).alias("brand_breadth"),
        )
    )

    events = engagement_events(t).withColumn("snapshot_no", calendar.index_of_next(F.col("event_timestamp")))
    event_part = _deltas(events, **{f"{k}_count": (F.col("event_type") == k).cast("int") for k in ENGAGEMENT_TYPES})

    reviews = t["reviews"].withColumn("snapshot_no", calendar.index_of_next(F.col("review_date")))
    reviews = reviews.select("user_id", "review_id", "rating", "snapshot_no")
    rated = {"rating_sum": F.col("rating"), "rating_rows": one, "negative_reviews": (F.col("rating") <= 2).cast("int")}
    written = _first_met(reviews, [by_snapshot, _kind("review", F.col("review_id"))], "review_id", hot, rated)
    review_part = _in_shape(
        written.groupBy("user_id", "snapshot_no").agg(*[at(m).alias(m) for m in rated], F.count_if(is_kind("review")).alias("review_count"))
    )

    merged = order_part
    for part in (outcome_part, item_part, event_part, review_part):
        merged = merged.unionByName(part)
    # Dealt by user, so that sums along a user's snapshots don't move the rows again.
    return merged.repartition("user_id").groupBy("user_id", "snapshot_no").agg(
        *[F.sum(m).alias(m) for m in _MEASURES], F.max("last_order_date").alias("last_order_date")
    )


def customer_snapshot_panel(t: Tables, calendar: SnapshotCalendar | None = None) -> DataFrame:
    """One row per (buyer, snapshot): history before the date, outcome in the 90 days after it.

    Deltas are summed along each user's snapshots (at most one row per
    snapshot date) and carried forward over snapshots without new facts.
    Order keys must be unique, which the key guard checks upstream; a repeated
    review id counts once.
    """
    calendar = calendar or snapshot_calendar(t["orders"])
    last_no = len(calendar.dates)
    by_user = Window.partitionBy("user_id").orderBy("snapshot_no")
    so_far = by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = snapshot_deltas(t, calendar).select(
        "user_id",
        F.col("snapshot_no").alias("from_no"),
        (F.lead("snapshot_no", 1, last_no + 1).over(by_user) - 1).alias("to_no"),
        *[F.sum(m).over(so_far).alias(m) for m in _RUNNING],
        F.max("last_order_date").over(so_far).alias("last_order_date"),
        *[F.col(m).alias(m) for m in _OUTCOME],
    )
    filled = running.filter("order_count > 0").withColumn("snapshot_no", F.explode(F.sequence("from_no", "to_no")))
    own = F.col("snapshot_no") == F.col("from_no")
    snap = F.col("snapshot_date")
    users = t["users"].select("user_id", "gender", "signup_date")
    whole = [m for m in _RUNNING if m not in ("total_spend", "total_quantity", "rating_sum", "rating_rows", "negative_reviews")]
    return (
        filled.withColumn("snapshot_date", calendar.date_at(F.col("snapshot_no")))
        .join(users, "user_id")
        .filter(F.col("signup_date") <= snap)
        .select(
            "user_id",
            "snapshot_date",
            "gender",
            "signup_date",
            "last_order_date",
            C.whole_days_clipped(snap, F.col("last_order_date")).alias("recency_days"),
            "total_spend",
            (F.col("total_spend") / F.col("order_count")).alias("avg_order_value"),
            C.log1p_floor_zero(F.col("total_spend")).alias("total_spend_log1p"),
            C.log1p_floor_zero(F.col("total_spend") / F.col("order_count")).alias("avg_order_value_log1p"),
            "total_quantity",
            *[F.col(m).cast("bigint").alias(m) for m in whole],
            F.coalesce(C.ratio(F.col("rating_sum"), F.col("rating_rows")), F.lit(0.0)).alias("avg_review_rating"),
            F.coalesce(C.ratio(F.col("negative_reviews"), F.col("rating_rows")), F.lit(0.0)).alias("negative_review_share"),
            C.whole_days_clipped(snap, F.col("signup_date")).alias("tenure_days"),
            F.when(own, F.col("future_order_count")).otherwise(0.0).cast("bigint").alias("future_order_count"),
            F.when(own, F.col("future_spend")).otherwise(0.0).alias("future_spend"),
        )
        .withColumn("churn", (F.col("future_order_count") == 0).cast("int"))
    )


def history_before(t: Tables, calendar: SnapshotCalendar) -> DataFrame:
    """Order count and spend before each snapshot as an as-of join of the orders' users and the snapshot dates.

    It goes by the timestamps themselves, which makes it a check of the panel,
    whose facts are dealt to snapshots by number.
    """
    dates = F.array(*[F.lit(d).cast("timestamp_ntz") for d in calendar.dates])
    first = t["orders"].groupBy("user_id").agg(F.min("order_date").alias("first_order"))
    points = first.select("user_id", "first_order", F.explode(dates).alias("order_date")).filter("first_order < order_date")
    sums = {"order_count": F.lit(1).cast("bigint"), "total_spend": F.col("total_amount")}
    found = totals_before(t["orders"], points.drop("first_order"), "user_id", "order_date", sums)
    return found.withColumnRenamed("order_date", "snapshot_date")


def current_customers(t: Tables, calendar: SnapshotCalendar | None = None) -> DataFrame:
    """The panel at the final snapshot only.

    Nothing but that date is built: history up to it is one bucket, so no row is carried forward.
    """
    calendar = calendar or snapshot_calendar(t["orders"])
    return customer_snapshot_panel(t, SnapshotCalendar((), calendar.final))


def event_pivot(t: Tables) -> DataFrame:
    """Counts of each engagement type per user; absent types count 0."""
    return (
        engagement_events(t).filter("user_id IS NOT NULL").groupBy("user_id").pivot("event_type", ENGAGEMENT_TYPES).count().fillna(0)
        .select("user_id", *[F.col(k).alias(f"{k}_count") for k in ENGAGEMENT_TYPES])
    )


# ---------------------------------------------------------------- segments


def rfm_segment(recency: Column, orders: Column) -> Column:
    return (
        F.when((recency <= 30) & (orders >= 3), "Champions")
        .when((recency > 90) & (orders >= 2), "At-risk")
        .when(recency > 180, "Lost")
        .when(orders == 1, "One-time")
        .otherwise("Core")
    )


def risk_band(segment: Column) -> Column:
    return (
        F.when(segment.isin("At-risk", "Lost"), "High").when(segment.isin("One-time", "Core"), "Medium").otherwise("Low")
    )


def with_segments(current: DataFrame) -> DataFrame:
    segment = rfm_segment(F.col("recency_days"), F.col("order_count"))
    return current.withColumns({"segment": segment, "risk_band": risk_band(segment)})


def risk_scores(current: DataFrame) -> DataFrame:
    """Rule-based churn risk per user from average-tie ranks of recency, orders and engagement."""
    engagement = F.col("view_count") + F.col("cart_count") + F.col("wishlist_count")
    ranks = percent_ranks(
        current,
        ["user_id"],
        {"recency_rank": F.col("recency_days"), "order_rank": F.col("order_count"), "engagement_rank": engagement},
    )
    score = 0.5 * F.col("recency_rank") + 0.25 * (1 - F.col("order_rank")) + 0.25 * (1 - F.col("engagement_rank"))
    return ranks.withColumn("risk_score", score)


def segment_summary(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("segment").agg(
        F.count_distinct("user_id").alias("customers"),
        F.sum("total_spend").alias("historical_spend"),
        F.avg("total_spend").alias("avg_historical_spend"),
        F.avg("churn").alias("observed_churn_rate"),
        F.avg("recency_days").alias("avg_recency_days"),
        F.avg("order_count").alias("avg_order_count"),
    )


def temporal_split(calendar: SnapshotCalendar, embargo_days: int = 0) -> tuple[list[datetime], list[datetime]]:
    """First 80% of the snapshot dates for training, the rest for testing.

    Outcomes look 90 days ahead, so late training labels reach into the test
    dates; ``embargo_days`` drops training dates closer than that to the first test date.
    """
    dates = calendar.dates
    cut = max(1, int(len(dates) * 0.8))
    train, test = dates[:cut], dates[cut:]
    if test and embargo_days:
        train = [d for d in train if (test[0] - d).days >= embargo_days]
    return train, test


def kpi_summary(t: Tables, segmented: DataFrame) -> DataFrame:
    """Headline figures of the retention run as (metric, value)."""
    from tallyback.plans.returns import metric_rows

    order_part = metric_rows(
        t["orders"], {"valid_order_count": F.count(F.lit(1)), "valid_order_value": F.sum("total_amount")}
    )
    buyer_part = metric_rows(
        segmented,
        {
            "historical_buyers": F.count_distinct("user_id"),
            "churn_count": F.sum("churn"),
            "churn_rate": F.avg("churn"),
            "active_next_90_days": F.count_if(F.col("churn") == 0),
            "at_risk_customers": F.count_if(F.col("segment") == "At-risk"),
        },
    )
    top_two = top_levels(revenue_share(t, "category"), "category", 2)
    share_part = metric_rows(top_two, {"top_two_category_share": F.sum("share")})
    gap_part = metric_rows(
        reconciliation_summary(t),
        {"orders_with_items": F.sum("orders_with_items"), "item_total_gap_rate": F.max("gap_rate")},
    )
    return order_part.unionByName(buyer_part).unionByName(share_part).unionByName(gap_part)
