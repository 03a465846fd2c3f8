"""The relation graph: candidate pairs by contact and nearest neighbours, evaluated edges, filters and canonical form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9


def all_pairs(entities: DataFrame, group: str = "image_id", key: str = "id") -> DataFrame:
    """Pairs of an image's entities, a before b."""
    a = entities.select(group, F.col(key).alias("a"))
    return a.join(entities.select(group, F.col(key).alias("b")), group).filter("a < b")


def knn(entities: DataFrame, axes: list[str], k: int, group: str = "image_id", key: str = "label") -> DataFrame:
    """The k nearest others of each entity by Euclidean distance over axes, ties by key.

    An equi-join inside an image, whose regions number a few hundred by configuration; the rank keeps k rows early.
    """
    a = entities.select(group, F.col(key).alias("s"), *(F.col(c).alias(f"__a_{c}") for c in axes))
    b = entities.select(group, F.col(key).alias("t"), *(F.col(c).alias(f"__b_{c}") for c in axes))
    d2 = sum(((F.col(f"__a_{c}") - F.col(f"__b_{c}")) * (F.col(f"__a_{c}") - F.col(f"__b_{c}")) for c in axes), F.lit(0.0))
    pairs = a.join(b, group).filter("s <> t").withColumn("d2", F.round(d2, 9))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(group, "s").orderBy("d2", "t"))).filter(F.col("rank") <= k).select(group, "s", "t", "rank", "d2")


def candidates(adjacent: DataFrame, spatial: DataFrame, appearance: DataFrame, group: str = "image_id") -> DataFrame:
    """a, b and the sorted reasons of each candidate pair."""
    near = lambda d, why: d.select(group, F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), F.lit(why).alias("why"))
    every = adjacent.select(group, "a", "b", F.lit("adjacent").alias("why")).unionByName(near(spatial, "spatial_knn")).unionByName(near(appearance, "appearance_knn"))
    return every.groupBy(group, "a", "b").agg(F.array_sort(F.collect_set("why")).alias("sources"))


def axial_difference(a: Column, b: Column) -> Column:
    """Difference of two axes in degrees, as a share of 180."""
    d = F.abs(F.radians(a) - F.radians(b)) % F.lit(math.pi)
    return F.least(d, F.lit(math.pi) - d) / math.pi


def relationships(pairs: DataFrame, entities: DataFrame, width: int, height: int, config: dict, group: str = "image_id") -> DataFrame:
    """Every measure of each candidate pair (a, b, sources, contacts), its kinds, affinity and confidence.

    entities: label, cx, cy, area, perimeter, compactness, orientation, hu1..hu7, lab_l, lab_a, lab_b, brightness,
    texture, gradient, edge_density, complexity; a small table an image, joined twice.
    """
    names = [c for c in entities.columns if c != group]
    s = entities.select(group, *(F.col(c).alias(f"s_{c}") for c in names)).withColumnRenamed("s_label", "a")
    t = entities.select(group, *(F.col(c).alias(f"t_{c}") for c in names)).withColumnRenamed("t_label", "b")
    e = pairs.join(s, [group, "a"]).join(t, [group, "b"])
    S, T = (lambda c: F.col(f"s_{c}")), (lambda c: F.col(f"t_{c}"))
    gap = lambda c: S(c) - T(c)
    sigma = max(config["labDeltaESigma"], EPSILON)
    w, shape = config["groupingWeights"], config["shapeWeights"]
    e = e.withColumns({"dx": T("cx") - S("cx"), "dy": T("cy") - S("cy")})
    e = e.withColumn("distance", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    e = e.withColumn("normalizedDistance", F.col("distance") / max(math.hypot(width, height), EPSILON))
    e = e.withColumn("colorDistance", F.sqrt(sum((gap(c) * gap(c) for c in ("lab_l", "lab_a", "lab_b")), F.lit(0.0))))
    e = e.withColumn("colorSimilarity", F.exp(-(F.col("colorDistance") * F.col("colorDistance")) / (2 * sigma * sigma)))
    hu = F.sqrt(sum((gap(f"hu{i}") * gap(f"hu{i}") for i in range(1, 8)), F.lit(0.0)))
    far = shape["compactness"] * F.abs(gap("compactness")) + shape["orientation"] * axial_difference(S("orientation"), T("orientation")) + shape["hu"] * F.least(hu / 25.0, F.lit(1.0))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    e = e.withColumns({
        "shapeSimilarity": clip(F.exp(-far)), "brightnessDifference": F.abs(gap("brightness")), "textureSimilarity": F.exp(-F.abs(gap("texture")) / 0.20), "gradientSimilarity": F.exp(-F.abs(gap("gradient")) / 0.30),
        "boundaryContactRatio": F.col("contacts") / F.greatest(F.least(S("perimeter"), T("perimeter")), F.lit(1.0)), "adjacent": F.array_contains("sources", "adjacent"),
        "areaRatio": S("area") / F.greatest(T("area"), F.lit(1)), "logAreaRatio": F.ln((S("area") + EPSILON) / (T("area") + EPSILON)), "logBrightnessRatio": F.ln((S("brightness") + EPSILON) / (T("brightness") + EPSILON)), "angle": F.degrees(F.atan2("dy", "dx")),
    })
    nd = F.col("normalizedDistance")
    affinity = w["space"] * F.exp(-(nd * nd) / (2 * 0.20 * 0.20)) + w["color"] * F.col("colorSimilarity") + w["brightness"] * F.exp(-F.col("brightnessDifference") / 0.20) + w["texture"] * F.col("textureSimilarity") + w["gradient"] * F.col("gradientSimilarity") + w["shape"] * F.col("shapeSimilarity") - w["boundary"] * ((S("edge_density") + T("edge_density")) / 2.0)
    load = (S("complexity") * S("area") + T("complexity") * T("area")) / F.greatest(S("area") + T("area"), F.lit(1))
    e = e.withColumn("__aff", affinity)
    e = e.withColumns({"affinity": clip(F.col("__aff")), "mergeAffinity": clip(F.col("__aff") * (1.0 - config["complexityMergePenalty"] * load))})
    e = e.withColumn("confidence", clip(0.35 * F.col("mergeAffinity") + 0.30 * F.col("adjacent").cast("double") + 0.20 * F.col("colorSimilarity") + 0.15 * F.col("shapeSimilarity")))
    kinds = F.array_compact(F.array(F.when(F.col("adjacent"), "adjacent"), F.when(nd <= 0.22, "near"), F.when(F.col("colorSimilarity") >= 0.82, "similar_color"), F.when(F.col("shapeSimilarity") >= 0.80, "similar_shape")))
    e = e.withColumn("kinds", F.when(F.size(kinds) == 0, F.array(F.lit("related"))).otherwise(kinds))
    out = ["dx", "dy", "distance", "normalizedDistance", "angle", "areaRatio", "logAreaRatio", "brightnessDifference", "logBrightnessRatio", "colorDistance", "colorSimilarity", "shapeSimilarity", "textureSimilarity", "gradientSimilarity", "boundaryContactRatio", "affinity", "mergeAffinity", "confidence"]
    return e.select(group, "a", "b", "sources", "kinds", F.col("kinds")[0].alias("primary"), "adjacent", *(F.bround(c, 8).alias(c) for c in out))


def filter_edges(edges: DataFrame, types: list[str], adjacent_only: bool, min_confidence: float, max_distance: float) -> DataFrame:
    """Edges of any of the types that pass all limits; edges without a distance fail."""
    any_type = F.arrays_overlap("kinds", F.array(*map(F.lit, types)))
    return edges.filter(any_type & (F.col("adjacent") | F.lit(not adjacent_only)) & (F.col("confidence") >= min_confidence) & (F.col("normalizedDistance") <= max_distance))


def touching(edges: DataFrame, entity: object) -> DataFrame:
    return edges.filter((F.col("a") == entity) | (F.col("b") == entity))


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode("kinds").alias("kind")).distinct()


def canonical(edges: DataFrame, payload: list[str]) -> DataFrame:
    """One edge for each payload, with the sorted union of the views that show it."""
    return edges.groupBy(*payload).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("views")))).alias("views"))


def render_key(edges: DataFrame) -> DataFrame:
    """Adds render_key: what a drawn edge is told apart by."""
    return edges.withColumn("render_key", F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), F.array_join(F.array_sort("kinds"), ","), F.regexp_replace(F.format_number("confidence", 8), ",", "")))


def containment(areas: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Which of two masks holds the other: overlaps (a, b, common) against areas (id, area)."""
    o = overlaps.join(areas.select(F.col("id").alias("a"), F.col("area").alias("area_a")), "a").join(areas.select(F.col("id").alias("b"), F.col("area").alias("area_b")), "b")
    which = F.when(F.col("common") == F.col("area_b"), "a_contains_b").when(F.col("common") == F.col("area_a"), "b_contains_a").otherwise("none")
    return o.select("a", "b", which.alias("containment"), (F.col("common") / F.least("area_a", "area_b")).alias("ratio"))


def iou(common: Column, a: Column, b: Column) -> Column:
    union = a + b - common
    return F.when(union == 0, 0.0).otherwise(common / union)
