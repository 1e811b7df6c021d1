"""Exact density clustering (core points, borders, noise) on a grid."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyback.session import cut_lineage

_FINE = 4  # each cell is cut into _FINE parts per axis to decide which cells touch
COMPARED = 256  # most point pairs of two boxes that are compared instead of halving the boxes


def _sum_of_squares(parts: list[Column]) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return total


def _squared_distance(columns: list[str], a: str, b: str) -> Column:
    return _sum_of_squares([F.col(f"{a}_{c}") - F.col(f"{b}_{c}") for c in columns])


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Steps to all cells that can hold a point within reach; cell diagonal equals the reach."""
    span = math.ceil(math.sqrt(dims))
    gap = lambda step: max(abs(step) - 1, 0) ** 2
    return [o for o in itertools.product(range(-span, span + 1), repeat=dims) if sum(map(gap, o)) <= dims]


def _cell_key(parts: list[Column]) -> Column:
    return F.concat_ws(":", *parts)


def _with_reachable(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """One row per neighbouring cell of each row (its own cell included)."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"s{i}") for i, v in enumerate(o)]) for o in _offsets(len(columns))])
    moved = df.withColumn("_step", F.explode(steps))
    key = _cell_key([F.col(f"cell_{c}") + F.col(f"_step.s{i}") for i, c in enumerate(columns)])
    return moved.withColumn(out, key).drop("_step")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest node of each connected component.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours. The number of
    rounds grows with the logarithm of the graph; lineage is cut after each.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links = cut_lineage(links)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = cut_lineage(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )


def _extents(points: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Corners and number of the points of each box."""
    corners = [f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy("cell", "box", *keys).agg(F.count(F.lit(1)).alias("points"), *corners)


def _judged(pairs: DataFrame, columns: list[str], reach: float) -> DataFrame:
    """Box pairs that may hold points within reach; ``sure`` where all of their points are."""
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}")) for c in columns
    ]
    spans = [F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}")) for c in columns]
    return pairs.filter(_sum_of_squares(gaps) <= reach * reach).select(
        "a_cell", "b_cell", "a_box", "b_box",
        (F.col("a_points") * F.col("b_points")).alias("work"), (_sum_of_squares(spans) <= reach * reach).alias("sure"),
    )


def _halved(points: DataFrame, boxes: DataFrame, columns: list[str]) -> DataFrame:
    """The points of ``boxes``, each axis of a box cut at the middle of its extent; any two unequal points part in the end."""
    edges = [f"{n}_{c}" for c in columns for n in ("lo", "hi")]
    halves = []
    for c in columns:
        low, high = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        middle = (low + high) / 2
        halves.append(F.when(middle >= high, F.col(c) >= high).otherwise(F.col(c) > middle).cast("int").cast("string"))
    inside = points.join(boxes.select("cell", "box", *edges), ["cell", "box"])
    return inside.select("cell", *columns, F.col("box").alias("parent"), F.concat("box", F.lit("/"), *halves).alias("box"))


def _cell_components(core: DataFrame, columns: list[str], reach: float, side: float) -> DataFrame:
    """(node, component) of the cells: linked where core points of both lie within reach.

    Core points fold into boxes, at first at most _FINE^d per cell however many
    points there are. Two boxes whose farthest corners are within reach prove a
    link, boxes too far apart rule it out. Cells proven linked are united
    before anything finer is done, so points are only ever looked at between
    different components: a pair of boxes of few points is compared, in larger ones
    every axis is halved and the parts are judged again. Work follows the pairs
    of cells that nearly touch, not the points of dense ones.
    """
    nodes = cut_lineage(core.select(F.col("cell").alias("node")).distinct())
    fine = side / _FINE
    box = _cell_key([F.floor(F.col(c) / fine) for c in columns])
    points = core.select("cell", *[f"cell_{c}" for c in columns], *columns, box.alias("box"))
    boxes = cut_lineage(_extents(points, columns, *[f"cell_{c}" for c in columns]))
    near = _with_reachable(boxes, columns, "other_cell").filter(F.col("cell") < F.col("other_cell"))
    pairs = _side(near, "a").join(_side(boxes, "b"), F.col("a_other_cell") == F.col("b_cell"))
    points = points.select("cell", "box", *columns)
    judged = cut_lineage(_judged(pairs, columns, reach))
    links = judged.filter("sure").select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")).distinct()
    labels = cut_lineage(connected_components(links, nodes))
    left = _between(judged.filter("NOT sure"), labels)
    while not left.isEmpty():
        compared = (
            left.filter(F.col("work") <= COMPARED)
            .join(_side(points, "a"), ["a_cell", "a_box"])
            .join(_side(points, "b"), ["b_cell", "b_box"])
            .filter(_squared_distance(columns, "a", "b") <= reach * reach)
        )
        labels = _united(labels, compared)
        left = _between(left.filter(F.col("work") > COMPARED), labels)
        if left.isEmpty():
            break
        open_boxes = left.select(F.col("a_cell").alias("cell"), F.col("a_box").alias("box")).union(left.select("b_cell", "b_box")).distinct()
        points = cut_lineage(_halved(points, boxes.join(open_boxes, ["cell", "box"]), columns))
        boxes = cut_lineage(_extents(points, columns, "parent"))
        points = points.drop("parent")
        one = _side(boxes, "a").withColumnRenamed("a_box", "a_part").withColumnRenamed("a_parent", "a_box")
        two = _side(boxes, "b").withColumnRenamed("b_box", "b_part").withColumnRenamed("b_parent", "b_box")
        parts = left.select("a_cell", "b_cell", "a_box", "b_box").join(one, ["a_cell", "a_box"]).join(two, ["b_cell", "b_box"])
        parts = parts.drop("a_box", "b_box").withColumnsRenamed({"a_part": "a_box", "b_part": "b_box"})
        boxes = boxes.drop("parent")
        judged = cut_lineage(_judged(parts, columns, reach))
        labels = _united(labels, judged.filter("sure"))
        left = _between(judged.filter("NOT sure"), labels)
    return labels


def _ends(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of cells with the components of both ends."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(f"{end}_cell"), F.col("component").alias(f"{end}_component")), f"{end}_cell")
    return pairs


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose cells are still in different components."""
    return cut_lineage(_ends(pairs, labels).filter("a_component <> b_component").drop("a_component", "b_component"))


def _united(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """Labels after the linked pairs of cells unite the components of their ends."""
    links = cut_lineage(_ends(linked.select("a_cell", "b_cell").distinct(), labels).select(F.col("a_component").alias("a"), F.col("b_component").alias("b")).distinct())
    if links.isEmpty():
        return labels
    roots = connected_components(links, labels.select(F.col("component").alias("node")).distinct())
    merged = labels.withColumnRenamed("component", "old").join(roots.withColumnRenamed("node", "old"), "old")
    return cut_lineage(merged.select("node", "component"))


def density_clusters(df: DataFrame, key: str, columns: list[str], reach: float, min_points: int) -> DataFrame:
    """(key, columns, cluster): clusters numbered from 0, noise -1; a border point joins its lowest cluster.

    The grid's cell diagonal equals ``reach``, so a cell with ``min_points``
    rows is all core and needs no comparisons. Only rows of thinner cells look
    at their neighbours, which costs each row at most a constant number of
    comparisons. Rows with equal coordinates are handled once.
    """
    side = reach / math.sqrt(len(columns))
    cells = {f"cell_{c}": F.floor(F.col(c) / side) for c in columns}
    cell = _cell_key([F.col(f"cell_{c}") for c in columns])
    points = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("weight")).withColumns(cells).withColumn("cell", cell)
    points = cut_lineage(points)
    sizes = points.groupBy("cell").agg(F.sum("weight").alias("cell_weight"))
    marked = cut_lineage(points.join(sizes, "cell").withColumn("dense", F.col("cell_weight") >= min_points))

    thin = _with_reachable(marked.filter("NOT dense"), columns, "target")
    others = marked.select("cell", "weight", *columns)
    close = (
        _side(thin.select("target", *columns), "a")
        .join(_side(others, "b"), F.col("a_target") == F.col("b_cell"))
        .filter(_squared_distance(columns, "a", "b") <= reach * reach)
    )
    crowd = close.groupBy(*[F.col(f"a_{c}").alias(c) for c in columns]).agg(F.sum("b_weight").alias("crowd"))
    judged = cut_lineage(
        marked.join(crowd, columns, "left").withColumn("core", F.col("dense") | (F.coalesce("crowd", F.lit(0)) >= min_points))
    )
    core = judged.filter("core")
    labels = _cell_components(core, columns, reach, side)
    core_labelled = core.join(labels.withColumnRenamed("node", "cell"), "cell").select("cell", "component", *columns)

    border = _with_reachable(judged.filter("NOT core"), columns, "target")
    borders = (
        _side(border.select("target", *columns), "a")
        .join(_side(core_labelled, "b"), F.col("a_target") == F.col("b_cell"))
        .filter(_squared_distance(columns, "a", "b") <= reach * reach)
        .groupBy(*[F.col(f"a_{c}").alias(c) for c in columns])
        .agg(F.min("b_component").alias("component"))
    )
    named = core_labelled.select("component", *columns).unionByName(borders.select("component", *columns))
    # one row per cluster
    numbers = cut_lineage(labels.select("component").distinct())
    numbers = numbers.withColumn("cluster", (F.row_number().over(Window.orderBy("component")) - 1).cast("int"))
    joined = named.join(numbers, "component").select("cluster", *columns)
    return df.join(joined, columns, "left").select(key, *columns, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
