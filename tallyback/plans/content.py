"""Product text vectors, similar products and recommendations.

Products with the same text share one vector, so all work is done per distinct
text ("content") and products come back in at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyback.operators.ranks import global_row_number
from tallyback.operators.sizing import settle
from tallyback.plans.retention import SnapshotCalendar, product_dimension, snapshot_calendar, with_segments
from tallyback.session import cut_lineage
from tallyback.sources.tables import Tables

TOKEN_PATTERN = r"\b\w\w+\b"
RARE_LIMIT = 500  # contents a term may occur in to be looked up directly
SIMILARITY_DIGITS = 9  # similarities are compared after rounding, so equal ones tie
TOP = 3


def product_contents(t: Tables) -> DataFrame:
    """Product id and its lower-case text (category, brand, name)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("category", F.lit("")), F.coalesce("brand", F.lit("")), F.coalesce("product_name", F.lit(""))))
    return product_dimension(t).select("product_id", text.alias("content"))


def _terms(text: Column) -> Column:
    """Words of two or more letters and pairs of neighbouring words."""
    words = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def content_vectors(products: DataFrame) -> DataFrame:
    """(content, term, weight): term count times ln((1+n)/(1+df)) + 1, scaled to unit length.

    Document frequencies count products. Vocabulary joins are broadcast only
    when the counted vocabulary is small.
    """
    contents = products.groupBy("content").agg(F.count(F.lit(1)).alias("products"))
    counts = (
        contents.select("content", "products", F.explode(_terms(F.col("content"))).alias("term"))
        .groupBy("content", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("products").alias("products"))
    )
    vocabulary = settle(
        counts.groupBy("term").agg(F.sum("products").alias("df"), F.count(F.lit(1)).alias("contents_with_term"))
    )
    total = products.agg(F.count(F.lit(1))).scalar()
    raw = F.col("tf") * (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0)
    weighted = counts.join(vocabulary, "term").select("content", "term", "contents_with_term", raw.alias("raw"))
    # a content holds as many terms as its text has words, so this window is small
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("content")))
    return weighted.select("content", "term", "contents_with_term", (F.col("raw") / length).alias("weight"))


def product_tfidf(t: Tables) -> DataFrame:
    products = product_contents(t)
    return products.join(content_vectors(products).drop("contents_with_term"), "content").select("product_id", "term", "weight")


def _dot(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("seed", "candidate").agg(F.sum(F.col("ws") * F.col("wc")).alias("similarity"))


def _sides(vectors: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = vectors.join(seeds.select("seed"), vectors.content == F.col("seed"), "left_semi").select(
        F.col("content").alias("seed"), "term", F.col("weight").alias("ws")
    )
    return left, vectors.select(F.col("content").alias("candidate"), "term", F.col("weight").alias("wc"))


def similar_contents(vectors: DataFrame, seeds: DataFrame, sizes: DataFrame, rare_limit: int = RARE_LIMIT) -> DataFrame:
    """Contents similar to each seed, complete down to the seed's ``depth`` in products.

    ``seeds`` holds (seed, depth), ``sizes`` holds (content, products).

    Lookups start from rare terms only: each seed term meets at most
    ``rare_limit`` contents, so their number is linear in the vocabulary. The
    common terms' share is then added for the pairs found. A content sharing no
    rare term with the seed cannot beat the length of the seed's common part;
    when the contents above that bound already fill the depth, the answer is
    exact. Only seeds where they do not go through the full term index.
    """
    rare = vectors.filter(F.col("contents_with_term") <= rare_limit)
    common = cut_lineage(
        vectors.filter(F.col("contents_with_term") > rare_limit)
        .groupBy("content")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("common"))
    )
    left, right = _sides(rare, seeds)
    found = _dot(left.join(right, "term"))
    itself = seeds.select("seed", F.col("seed").alias("candidate"), F.lit(0.0).alias("similarity"))
    found = found.unionByName(itself.join(found, ["seed", "candidate"], "left_anti"))
    with_common = (
        found.join(common.select(F.col("content").alias("seed"), F.col("common").alias("cs")), "seed", "left")
        .join(common.select(F.col("content").alias("candidate"), F.col("common").alias("cc")), "candidate", "left")
    )
    entries = F.coalesce(F.map_entries("cs"), F.array().cast("array<struct<key:string,value:double>>"))
    shared = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("cc", e["key"]), F.lit(0.0)))
    scored = cut_lineage(
        with_common.select("seed", "candidate", F.round(F.col("similarity") + shared, SIMILARITY_DIGITS).alias("similarity")).join(
            sizes.withColumnRenamed("content", "candidate"), "candidate"
        )
    )
    bound = F.coalesce(
        F.sqrt(F.aggregate(F.map_values("common"), F.lit(0.0), lambda acc, w: acc + w * w)), F.lit(0.0)
    )
    bounds = seeds.join(common.withColumnRenamed("content", "seed"), "seed", "left").select("seed", "depth", bound.alias("bound"))
    settled = (
        scored.join(bounds, "seed")
        .filter(F.col("similarity") > F.col("bound") + 1e-6)
        .groupBy("seed", "depth")
        .agg(F.sum("products").alias("covered"))
        .filter(F.col("covered") >= F.col("depth"))
        .select("seed")
    )
    open_seeds = seeds.join(settled, "seed", "left_anti")
    left, right = _sides(vectors, open_seeds)
    full = _dot(left.join(right, "term")).withColumn("similarity", F.round("similarity", SIMILARITY_DIGITS))
    full = full.join(sizes.withColumnRenamed("content", "candidate"), "candidate")
    return scored.join(settled, "seed", "left_semi").unionByName(full.select(*scored.columns))


def ranked_products(similar: DataFrame, seeds: DataFrame, products: DataFrame) -> DataFrame:
    """The first ``depth`` products per seed by (similarity, product id).

    Contents are taken while the products of strictly more similar ones do not
    fill the depth yet, and at most ``depth`` products of each.
    """
    in_content = global_row_number(products, [F.col("content"), F.col("product_id")], "place")
    starts = in_content.groupBy("content").agg(F.min("place").alias("start"))
    placed = in_content.join(starts, "content").select(
        F.col("content").alias("candidate"), "product_id", (F.col("place") - F.col("start") + 1).alias("place")
    )
    better = Window.partitionBy("seed").orderBy(F.desc("similarity")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("seed", "similarity")
    needed = (
        similar.withColumn("before", F.sum("products").over(better) - F.sum("products").over(ties))
        .join(seeds, "seed")
        .filter(F.col("before") < F.col("depth"))
        .select("seed", "depth", "candidate", "similarity")
    )
    order = Window.partitionBy("seed").orderBy(F.desc("similarity"), "product_id")
    return (
        needed.join(placed, "candidate")
        .filter(F.col("place") <= F.col("depth"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("depth"))
        .select("seed", "product_id", "similarity", "rank")
    )


def _content_frames(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, vectors and sizes, with each text replaced by a number: pair tables then carry 8 bytes a side."""
    texts = cut_lineage(product_contents(t))
    numbers = global_row_number(texts.select("content").distinct(), [F.col("content")], "number")

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(numbers, "content").drop("content").withColumnRenamed("number", "content")

    products, vectors = cut_lineage(numbered(texts)), cut_lineage(numbered(content_vectors(texts)))
    sizes = products.groupBy("content").agg(F.count(F.lit(1)).alias("products"))
    return products, vectors, sizes


def content_similarity(t: Tables, top: int = TOP, rare_limit: int = RARE_LIMIT) -> DataFrame:
    """The ``top`` most similar other products of every product, ties by product id."""
    products, vectors, sizes = _content_frames(t)
    seeds = cut_lineage(sizes.select(F.col("content").alias("seed"), F.lit(top + 1).alias("depth")))
    ranked = ranked_products(similar_contents(vectors, seeds, sizes, rare_limit), seeds, products)
    own = products.select(F.col("content").alias("seed"), F.col("product_id").alias("seed_product_id"))
    order = Window.partitionBy("seed_product_id").orderBy("rank")
    return (
        own.join(ranked, "seed")
        .filter(F.col("seed_product_id") != F.col("product_id"))
        .withColumn("similarity_rank", F.row_number().over(order))
        .filter(F.col("similarity_rank") <= top)
        .select("seed_product_id", F.col("product_id").alias("similar_product_id"), "similarity", "similarity_rank")
    )


# ---------------------------------------------------------------- recommendations


def items_before(t: Tables, calendar: SnapshotCalendar) -> DataFrame:
    dated = t["orders"].filter(F.col("order_date") < F.lit(calendar.final).cast("timestamp_ntz")).select("order_id", "order_date")
    return t["order_items"].join(dated, "order_id")


def last_purchases(history: DataFrame) -> DataFrame:
    """Last product per user by (date, line id): a mergeable maximum, so a busy user needs no window."""
    newest = F.max(F.struct("order_date", "order_item_id", "product_id")).alias("newest")
    return history.groupBy("user_id").agg(newest).select("user_id", F.col("newest.product_id").alias("seed_product_id"))


def unseen_candidates(candidates: DataFrame, purchases: DataFrame) -> DataFrame:
    """Candidate rows (user, product, ...) the user has not bought yet."""
    return candidates.join(purchases.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")


def popular_products(purchases: DataFrame) -> DataFrame:
    """Products by number of buyers, numbered from 1."""
    counts = purchases.groupBy("product_id").agg(F.count("user_id").alias("buyers"))
    return global_row_number(counts, [F.desc("buyers"), F.col("product_id")], "popularity_rank")


def first_unbought(users: DataFrame, ranked: DataFrame, purchases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` unbought products per user down to the user's ``reach``, by (similarity, product id).

    Most users have them among the first 2 ``top`` ranks, so these are looked up first; the ranks down to the reach, as many as a
    user has purchases, are joined only for the users that still lack some.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("similarity"), "product_id")

    def found(asked: DataFrame, depth: Column) -> DataFrame:
        candidates = asked.join(ranked, "seed").filter(F.col("rank") <= depth)
        placed = unseen_candidates(candidates, purchases).withColumn("recommendation_rank", F.row_number().over(order))
        return placed.filter(F.col("recommendation_rank") <= top).select(
            "user_id", "segment", "seed_product_id", "product_id", "similarity", "recommendation_rank"
        )

    near = cut_lineage(found(users, F.least(F.col("reach"), F.lit(2 * top))))
    full = near.filter(F.col("recommendation_rank") == top).select("user_id")
    rest = found(cut_lineage(users.join(full, "user_id", "left_anti")), F.col("reach"))
    return cut_lineage(near.join(full, "user_id", "left_semi").unionByName(rest))


def content_recommendations(t: Tables, current: DataFrame, calendar: SnapshotCalendar | None = None, top: int = TOP) -> DataFrame:
    """``top`` unbought products per current customer, most similar to the last purchase first.

    A user who bought p products finds the first unbought ones within the first
    p + ``top`` ranks, so that is how deep each list is read: the rows looked
    at grow with the purchases, not with users times products. Users left with
    too few similar products are filled from the popularity list and marked.
    """
    calendar = calendar or snapshot_calendar(t["orders"])
    history = items_before(t, calendar)
    purchases = cut_lineage(history.select("user_id", "product_id").distinct())
    products, vectors, sizes = _content_frames(t)
    bought = purchases.groupBy("user_id").agg(F.count(F.lit(1)).alias("bought"))
    users = cut_lineage(
        with_segments(current)
        .select("user_id", "segment")
        .join(last_purchases(history), "user_id")
        .join(products.withColumnRenamed("product_id", "seed_product_id"), "seed_product_id")
        .join(bought, "user_id")
        .select("user_id", "segment", "seed_product_id", F.col("content").alias("seed"), (F.col("bought") + top).alias("reach"))
    )
    seeds = cut_lineage(users.groupBy("seed").agg(F.max("reach").alias("depth")))
    ranked = cut_lineage(ranked_products(similar_contents(vectors, seeds, sizes), seeds, products))
    similar = first_unbought(users, ranked, purchases, top)
    have = similar.groupBy("user_id").agg(F.count(F.lit(1)).alias("have"))
    short = cut_lineage(users.join(have, "user_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < top))
    wanted = short.withColumn("popularity_rank", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("reach") + top)))
    fill = (
        unseen_candidates(unseen_candidates(wanted.join(popular_products(purchases), "popularity_rank"), purchases), similar)
        .withColumn("extra", F.row_number().over(Window.partitionBy("user_id").orderBy("popularity_rank")))
        .filter(F.col("have") + F.col("extra") <= top)
        .select(
            "user_id", "segment", "seed_product_id", "product_id", F.lit(0.0).alias("similarity"),
            (F.col("have") + F.col("extra")).cast("int").alias("recommendation_rank"),
        )
    )
    return (
        similar.withColumn("source", F.lit("similar text"))
        .unionByName(fill.withColumn("source", F.lit("popular")))
        .withColumnRenamed("product_id", "recommended_product_id")
    )
