"""Regions: partitions of pixels by label, their exact mergeable statistics, geometry and borders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixrel.operators.stencil import by_col, by_row
from pixrel.plans.shared import saved

KEY = ["image_id", "label"]
#: Fields of the sufficient statistics.
FIELDS = ("red", "green", "blue", "lightness", "lab_l", "lab_a", "lab_b", "gradient_magnitude", "edge_strength", "local_variance", "local_entropy", "complexity")


def grid_shape(width: int, height: int, target: int) -> tuple[int, int]:
    """Rows and columns of about target cells, as square as the image allows; 2 cells at least, a pixel each at most."""
    target = min(max(target, 2), width * height)
    rows = max(1, round(math.sqrt(target * height / max(width, 1))))
    return rows, -(-target // rows)


def grid_labels(p: DataFrame, width: int, height: int, target: int) -> DataFrame:
    """Adds label: cells of grid_shape, numbered from 1 in reading order."""
    rows, cols = grid_shape(width, height, target)
    cell = F.least(F.expr(f"y * {rows} div {height}"), F.lit(rows - 1)) * cols + F.least(F.expr(f"x * {cols} div {width}"), F.lit(cols - 1))
    return p.withColumn("label", (cell + 1).cast("int"))


def relabel(p: DataFrame) -> DataFrame:
    """Labels without gaps, in order; ranked on the few labels, then joined."""
    names = p.select(*KEY).distinct().withColumn("__new", F.dense_rank().over(Window.partitionBy("image_id").orderBy("label")).cast("int"))
    return p.join(names, KEY).withColumn("label", F.col("__new")).drop("__new")


def statistics(p: DataFrame, fields: list[str], key: list[str] = KEY) -> DataFrame:
    """count, sum_<field>, sq_<field>: add them up to merge regions."""
    aggs = [F.count(F.lit(1)).alias("count")]
    for c in fields:
        v = F.col(c)
        aggs += [F.sum(v).alias(f"sum_{c}"), F.sum(v * v).alias(f"sq_{c}")]
    return p.groupBy(*key).agg(*aggs)


def merge_statistics(stats: DataFrame, parent: list[str]) -> DataFrame:
    """Statistics of parents from those of their children, without their pixels."""
    return stats.groupBy(*parent).agg(*(F.sum(c).alias(c) for c in stats.columns if c == "count" or c.startswith(("sum_", "sq_"))))


def mean(c: str) -> Column:
    return F.col(f"sum_{c}") / F.col("count")


def variance(c: str) -> Column:
    """Population variance, never below 0."""
    return F.greatest(F.col(f"sq_{c}") / F.col("count") - mean(c) * mean(c), F.lit(0.0))


def geometry(p: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Bounding box, area, centroid and principal axis (degrees below 180) of each region, from integer moments."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    g = p.groupBy(*key).agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    n = F.col("area")
    cxx, cxy, cyy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("sxy") - F.col("sx") * F.col("sy"), n * F.col("syy") - F.col("sy") * F.col("sy")
    angle = F.when(n < 2, 0.0).otherwise(F.pmod(F.degrees(0.5 * F.atan2((2 * cxy).cast("double"), (cxx - cyy).cast("double"))), F.lit(180.0)))
    return g.select(*key, "area", "min_x", "min_y", "max_x", "max_y", (F.col("sx") / n).alias("cx"), (F.col("sy") / n).alias("cy"), angle.alias("orientation"))


def perimeter(p: DataFrame) -> DataFrame:
    """Perimeter of each region: its border pixels (a 4-neighbour lies outside) weigh 1, sqrt 2 or their mean, by how
    many border pixels of the region join them straight and diagonally."""
    out = lambda w, f: F.coalesce(f("label").over(w) != F.col("label"), F.lit(True))
    b = p.withColumn("__edge", (out(by_row(), F.lag) | out(by_row(), F.lead) | out(by_col(), F.lag) | out(by_col(), F.lead)).cast("int"))
    b = b.filter("__edge = 1").select("image_id", "label", "y", "x")
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(10 if dx and dy else 2).alias("w")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy))
    near = b.withColumn("s", F.explode(steps)).select("image_id", "label", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("s.w").alias("w"))
    code = b.join(near, ["image_id", "label", "y", "x"], "left").groupBy("image_id", "label", "y", "x").agg((F.coalesce(F.sum("w"), F.lit(0)) + 1).alias("code"))
    weight = F.when(F.col("code").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("code").isin(21, 33), math.sqrt(2)).when(F.col("code").isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return code.groupBy(*KEY).agg(F.sum(weight).alias("perimeter"))


def compactness(area: Column, around: Column) -> Column:
    return 4 * math.pi * area / F.greatest(around * around, F.lit(1e-9))


def hu_moments(p: DataFrame) -> DataFrame:
    """hu: seven invariants of each region, as signed negative logarithms."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    c = p.groupBy(*KEY).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = p.join(c, KEY).withColumns({"u": x - F.col("mx"), "v": y - F.col("my")})
    names = [(i, j) for i in range(4) for j in range(4) if 2 <= i + j <= 3]
    power = lambda c, k: F.lit(1.0) if not k else F.col(c) if k == 1 else F.col(c) * power(c, k - 1)
    m = d.groupBy(*KEY).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(power("u", i) * power("v", j)).alias(f"m{i}{j}") for i, j in names))
    m = m.select(*KEY, *((F.col(f"m{i}{j}") / F.pow("n", F.lit(1 + (i + j) / 2))).alias(f"e{i}{j}") for i, j in names))
    e = {n: F.col(f"e{n}") for n in ("20", "02", "11", "30", "03", "21", "12")}
    a, b = e["30"] + e["12"], e["21"] + e["03"]
    p_, q = e["30"] - 3 * e["12"], 3 * e["21"] - e["03"]
    hu = [
        e["20"] + e["02"], (e["20"] - e["02"]) * (e["20"] - e["02"]) + 4 * e["11"] * e["11"], p_ * p_ + q * q, a * a + b * b,
        p_ * a * (a * a - 3 * b * b) + q * b * (3 * a * a - b * b), (e["20"] - e["02"]) * (a * a - b * b) + 4 * e["11"] * a * b, q * a * (a * a - 3 * b * b) - p_ * b * (3 * a * a - b * b),
    ]
    snap = lambda v: F.when(F.abs(v) < 1e-15, 0.0).otherwise(v)  # noqa: E731  rounding noise of moments that are 0
    signed = lambda v: -F.when(snap(v) < 0, -1.0).otherwise(1.0) * F.log10(F.greatest(F.abs(snap(v)), F.lit(1e-30)))
    return m.select(*KEY, *(signed(v).alias(f"hu{i}") for i, v in enumerate(hu, 1)))


def contacts(p: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Pairs of 4-neighbours of different labels: a below b, direction, and for carried fields the value on both sides."""
    carry = carry or []
    out = None
    for w, name in ((by_row(), "h"), (by_col(), "v")):
        d = p.withColumn("__n", F.lead("label").over(w)).withColumns({f"__n_{c}": F.lead(c).over(w) for c in carry}).filter(F.col("__n") != F.col("label"))
        d = d.select("image_id", F.least("label", "__n").alias("a"), F.greatest("label", "__n").alias("b"), F.lit(name).alias("direction"), *(F.col(c).alias(f"{c}_1") for c in carry), *(F.col(f"__n_{c}").alias(f"{c}_2") for c in carry))
        out = d if out is None else out.unionByName(d)
    return out


def shared_boundary(p: DataFrame) -> DataFrame:
    """Contacts of each pair of adjacent regions."""
    return contacts(p).groupBy("image_id", "a", "b").agg(F.count(F.lit(1)).alias("contacts"))


def pair_edge_strength(p: DataFrame, field: str = "edge_strength") -> DataFrame:
    """Mean of a field on both sides of all contacts of a pair."""
    return contacts(p, [field]).groupBy("image_id", "a", "b").agg((F.sum(F.col(f"{field}_1") + F.col(f"{field}_2")) / (2 * F.count(F.lit(1)))).alias("edge"))


def interior_boundary(p: DataFrame) -> DataFrame:
    """Adds boundary: true where one of the 8 neighbours inside the image has another label."""
    lo = F.array_min(F.array(*(F.coalesce(f("label").over(by_row()), F.col("label")) for f in (F.lag, F.lead)), F.col("label")))
    hi = F.array_max(F.array(*(F.coalesce(f("label").over(by_row()), F.col("label")) for f in (F.lag, F.lead)), F.col("label")))
    d = p.withColumns({"__lo": lo, "__hi": hi})
    ends = lambda c, pick: pick(F.array(*(F.coalesce(f(c).over(by_col()), F.col("label")) for f in (F.lag, F.lead)), F.col(c)))
    return d.withColumn("boundary", (ends("__lo", F.array_min) != F.col("label")) | (ends("__hi", F.array_max) != F.col("label"))).drop("__lo", "__hi")


def tiny_region_targets(p: DataFrame, minimum: int) -> DataFrame:
    """For each region below minimum pixels the label most frequent among the pixels around it, the least of equals."""
    size = p.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") < minimum)
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    ring = p.join(size, KEY).withColumn("s", F.explode(steps)).select("image_id", F.col("label").alias("tiny"), "size", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    votes = ring.join(p.select("image_id", "y", "x", "label"), ["image_id", "y", "x"]).filter("label <> tiny").groupBy("image_id", "tiny", "size", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = F.row_number().over(Window.partitionBy("image_id", "tiny").orderBy(F.desc("votes"), "label"))
    return votes.withColumn("__k", best).filter("__k = 1").select("image_id", "tiny", "size", F.col("label").alias("target"), "votes")


def components(p: DataFrame, value: str = "label") -> DataFrame:
    """Adds component: the first pixel (y * 2**20 + x) of the 4-connected area of one value.

    Runs of a row are nodes, contacts of runs in neighbouring rows are links; least labels spread along links and
    jump, so rounds grow with the logarithm of an area's extent.
    """
    start = (F.coalesce(F.lag(value).over(by_row()) != F.col(value), F.lit(True))).cast("int")
    d = p.withColumn("__s", start).withColumn("__run", F.max(F.when(F.col("__s") == 1, F.col("y").cast("long") * (1 << 20) + F.col("x"))).over(by_row()))
    links = d.withColumns({"__up": F.lag("__run").over(by_col()), "__uv": F.lag(value).over(by_col())}).filter(F.col("__uv") == F.col(value)).select("image_id", F.col("__run").alias("u"), F.col("__up").alias("v")).distinct()
    both = saved(links.unionByName(links.select("image_id", F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = saved(d.select("image_id", F.col("__run").alias("u")).distinct().withColumn("c", F.col("u")))
    while True:
        near = both.join(labels.select("image_id", F.col("u").alias("v"), F.col("c").alias("n")), ["image_id", "v"]).groupBy("image_id", "u").agg(F.min("n").alias("n"))
        step = labels.join(near, ["image_id", "u"], "left").select("image_id", "u", F.least("c", F.coalesce("n", "c")).alias("m"), "c")
        jump = labels.select("image_id", F.col("u").alias("m"), F.col("c").alias("j"))
        step = saved(step.join(jump, ["image_id", "m"]).select("image_id", "u", F.least("m", "j").alias("m"), "c"))
        changed = step.filter("m <> c").limit(1).count()
        labels = step.select("image_id", "u", F.col("m").alias("c"))
        if not changed:
            break
    return d.join(labels.select("image_id", F.col("u").alias("__run"), F.col("c").alias("component")), ["image_id", "__run"]).drop("__s", "__run")
