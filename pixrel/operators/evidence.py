"""Evidence of a run: entities and their projections, look-ups, densities, gates, documents of other versions, formats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixrel.config import SUPPORTED_VERSIONS
from pixrel.operators import regions

#: Values of an entity's vector in their order, before the seven shape invariants: fixed values.
VECTOR = (
    "centroid_x", "centroid_y", "width", "height", "area", "perimeter", "compactness", "orientation", "red", "green", "blue", "lab_l", "lab_a", "lab_b",
    "var_red", "var_green", "var_blue", "var_lab_l", "gradient_magnitude", "var_gradient_magnitude", "edge_strength", "local_variance", "local_entropy", "complexity",
)


def statistics_fields(p: DataFrame) -> DataFrame:
    """Feature pixels with the twelve fields of the sufficient statistics, channels as shares of 255."""
    return p.withColumns({"red": F.col("r") / 255.0, "green": F.col("g") / 255.0, "blue": F.col("b") / 255.0, "lightness": F.col("gray") / 255.0, "gradient_magnitude": F.col("edge_strength")} | {c: F.col(c).cast("double") for c in ("lab_l", "lab_a", "lab_b", "edge_strength", "local_variance", "local_entropy", "complexity")})


def entities(p: DataFrame, key: tuple[str, str] = ("image_id", "label")) -> DataFrame:
    """Each region's geometry, means, variances and vector of 31 values, from labelled feature pixels: joins of one row a region.

    The statistics and the geometry must count the same pixels, else the run fails.
    """
    q = statistics_fields(p)
    g = regions.geometry(q).join(regions.perimeter(q), list(key)).join(regions.hu_moments(q), list(key))
    s = regions.statistics(q, list(regions.FIELDS))
    j = g.join(s, list(key)).withColumn("area", F.when(F.col("area") == F.col("count"), F.col("area")).otherwise(F.raise_error(F.lit("statistics and geometry count different pixels"))))
    j = j.withColumns({"centroid_x": F.col("cx"), "centroid_y": F.col("cy"), "width": F.col("max_x") - F.col("min_x") + 1, "height": F.col("max_y") - F.col("min_y") + 1, "compactness": regions.compactness(F.col("area"), F.col("perimeter"))})
    j = j.withColumns({c: regions.mean(c) for c in regions.FIELDS} | {f"var_{c}": regions.variance(c) for c in ("red", "green", "blue", "lightness", "lab_l", "gradient_magnitude")})
    vector = F.array(*(F.bround(F.col(c).cast("double"), 8) for c in (*VECTOR, *(f"hu{i}" for i in range(1, 8)))))
    drop = [c for c in j.columns if c.startswith(("sum_", "sq_")) or c == "count"]
    return j.withColumn("vector", vector).drop(*drop)


def lookup(entities: DataFrame, key: object, column: str = "id") -> DataFrame:
    """The entity of that id; asking for one that is not there is an error when the row is read."""
    found = entities.filter(F.col(column) == key)
    missing = entities.sparkSession.range(1).join(found.select(F.lit(1).alias("__one")).limit(1), F.lit(True), "left").filter("__one is null")
    return found.unionByName(missing.select(*(F.raise_error(F.lit(f"no entity {key}")).cast(f.dataType).alias(f.name) for f in entities.schema)))


def hierarchy(entities: DataFrame) -> DataFrame:
    """Four fields of each entity: what it is, where it hangs."""
    return entities.select("id", "type", "level", F.col("parent").alias("parent_id"))


def public(results: DataFrame, private: tuple[str, ...] = ("error_evidence",)) -> DataFrame:
    """Results without their private columns."""
    return results.drop(*private)


def default_entity(entities: DataFrame) -> DataFrame:
    """Of each image the first micro-region by level and id, else its root."""
    first = F.min(F.when(F.col("type") == "micro_region", F.col("id")))
    return entities.groupBy("image_id").agg(F.coalesce(first, F.min(F.when(F.col("type") == "image", F.col("id")))).alias("id"))


def by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("image_id", "type").agg(F.count(F.lit(1)).alias("entities"))


def density(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges for each entity of an image; images without edges have 0."""
    n = entities.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy("image_id").agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, "image_id", "left").select("image_id", F.bround(F.coalesce("m", F.lit(0)) / F.greatest("n", F.lit(1)), 8).alias("density"))


def first_edges(edges: DataFrame, most: int = 8) -> DataFrame:
    """The first edges of every entity, whichever end it is: a top-k by strength, then ends; ranks keep few rows early."""
    ends = edges.withColumn("entity", F.explode(F.array("a", "b")))
    w = Window.partitionBy("image_id", "entity").orderBy(F.desc("confidence"), "a", "b")
    return ends.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the centroids of both ends; edges that lack one are left out."""
    side = lambda k: entities.select("image_id", F.col("id").alias(k), F.col("centroid_x").alias(f"{k}_x"), F.col("centroid_y").alias(f"{k}_y"))
    return edges.join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"])


def segments(edges: DataFrame, by_distance: bool = False) -> DataFrame:
    """Lines of a drawn graph from endpoints(): whole pixels, and a colour by contact or by distance."""
    at = lambda c: F.bround(F.col(c), 0).cast("int")
    d = F.col("normalizedDistance")
    colour = F.array((255 * d).cast("int"), (255 * (1 - d)).cast("int"), F.lit(0)) if by_distance else F.when(F.col("adjacent"), F.array(F.lit(70), F.lit(230), F.lit(70))).otherwise(F.array(F.lit(40), F.lit(170), F.lit(230)))
    return edges.select("image_id", "a", "b", at("a_x").alias("x1"), at("a_y").alias("y1"), at("b_x").alias("x2"), at("b_y").alias("y2"), colour.alias("rgb"))


def scale_gate(images: DataFrame, enabled: bool, most: int) -> DataFrame:
    """Whether an image's resolutions are compared: images has pixels."""
    return images.withColumn("status", F.when(F.lit(not enabled), "disabled").when(F.col("pixels") > most, "skipped_pixel_limit").otherwise("completed"))


def cross_scale_link(links: DataFrame, entity: object) -> DataFrame:
    """The first link that has the entity at one end, by its ends."""
    return links.filter((F.col("source") == entity) | (F.col("target") == entity)).orderBy("factor", "source", "target").limit(1)


def adaptive_segments(p: DataFrame, least: int = 8, most: int = 180, base: int = 72) -> DataFrame:
    """Segments for each image by how complex it is: the base scaled by the mean and the upper quarter of its complexity."""
    a = p.groupBy("image_id").agg(F.avg("complexity").alias("mean"), F.percentile("complexity", 0.75).alias("upper"))
    return a.withColumn("segments", F.least(F.lit(most), F.greatest(F.lit(least), F.bround(base * (0.5 + F.col("mean") + F.col("upper")), 0).cast("int"))))


#: Names of the views that documents of each version are read as: fixed values.
COMPATIBILITY = {"0.2.0": "legacy-v0.2", "0.3.0": "native-v0.3", "0.4.0": "native-v0.4-with-correspondence-alias", "0.5.0": "native-v0.5", "0.6.0": "native-v0.6", "0.7.0": "native-v0.7"}
DOCUMENT = "representation_version string, version string, entities array<struct<id: string, type: string, crossScaleParentId: string, crossScaleMatchId: string>>, relationships array<struct<sourceId: string, targetId: string>>, hierarchy map<string, string>"


def read_documents(documents: DataFrame, text: str = "body") -> DataFrame:
    """The stable view of documents of any supported version; another version is an error.

    Version 0.4 told a match as a parent: where an entity has no match of its own, that is its match.
    """
    d = documents.withColumn("__d", F.from_json(text, DOCUMENT))
    version = F.coalesce(F.nullif("__d.representation_version", F.lit("")), F.nullif("__d.version", F.lit("")))
    d = d.withColumn("version", F.when(version.isin(*SUPPORTED_VERSIONS), version).otherwise(F.raise_error(F.concat(F.lit("Unsupported representation version: "), F.coalesce(version, F.lit("missing")), F.lit(".")))))
    aliased = lambda e: e.withField("crossScaleMatchId", F.coalesce(F.nullif(e["crossScaleMatchId"], F.lit("")), e["crossScaleParentId"]))
    items = F.coalesce("__d.entities", F.array().cast("array<struct<id: string, type: string, crossScaleParentId: string, crossScaleMatchId: string>>"))
    name = F.create_map(*(F.lit(x) for kv in COMPATIBILITY.items() for x in kv))[F.col("version")]
    keep = [c for c in documents.columns if c != text]
    return d.select(*keep, "version", F.when(F.col("version") == "0.4.0", F.transform(items, aliased)).otherwise(items).alias("entities"), F.coalesce("__d.relationships", F.array().cast("array<struct<sourceId: string, targetId: string>>")).alias("relationships"), "__d.hierarchy", name.alias("compatibility"))


def progress_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Reports from lines of JSON; lines that are no report are dropped."""
    r = F.from_json(text, "stage string, percent double, message string")
    d = lines.withColumn("__r", r).filter(F.col("__r.stage").isNotNull() & F.col("__r.percent").isNotNull())
    return d.select(*(c for c in lines.columns if c != text), "__r.stage", "__r.percent", F.coalesce("__r.message", F.lit("")).alias("message"))


def merge_percent(iteration: Column, merges: Column) -> Column:
    """Percent of the whole run while the tree grows: 51 to 63."""
    n = F.greatest(merges, F.lit(1))
    return F.least(F.lit(63), 51 + F.floor(12 * F.least(F.greatest(iteration, F.lit(0)), n) / n)).cast("int")


def nested_percent(fraction: Column) -> Column:
    """Percent of the whole run while a study's variants run: 89 to 93."""
    return F.least(F.lit(93), 89 + F.floor(4 * F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)))).cast("int")


def heartbeats(events: DataFrame, interval_ms: int = 2_000) -> DataFrame:
    """Of events (job, seq, now_ms, forced) those that are passed on: forced ones, and others an interval after the one before.

    What passes depends on what passed before; in windows of the interval after each forced event the first report
    of a window is the one that passes, so a window function over those windows suffices.
    """
    w = Window.partitionBy("job").orderBy("now_ms", "seq")
    d = events.withColumn("anchor", F.max(F.when(F.col("forced"), F.col("now_ms"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slot = F.expr(f"(now_ms - coalesce(anchor, 0)) div {interval_ms}")
    d = d.withColumn("slot", slot)
    first = F.row_number().over(Window.partitionBy("job", "anchor", "slot").orderBy(F.desc("forced"), "now_ms", "seq"))
    return d.withColumn("__k", first).filter(F.col("forced") | ((F.col("__k") == 1) & ((F.col("slot") > 0) | F.col("anchor").isNull()))).drop("anchor", "slot", "__k")


def member_pixels(p: DataFrame, factor: int = 1) -> DataFrame:
    """Pixels of each region as [x, y] in reading order, times the scale's factor."""
    at = F.array_sort(F.collect_list(F.struct((F.col("y") * factor).alias("y"), (F.col("x") * factor).alias("x"))))
    return p.groupBy("image_id", "label").agg(F.transform(at, lambda v: F.array(v["x"], v["y"])).alias("pixels"))


def legacy_similarity(a: list[Column], b: list[Column]) -> Column:
    """Colour similarity of the second engine: linear in the RGB distance."""
    return 1.0 - F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))) / math.sqrt(3 * 255.0**2)


def legacy_confidence(affinity: Column, contact: Column, similarity: Column) -> Column:
    """Confidence of the second engine's edges."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.25 + 0.35 * affinity + 0.2 * contact + 0.2 * similarity))


def mutual_contact(p: DataFrame, perimeters: DataFrame) -> DataFrame:
    """Contact of the second engine: pixels of each of two regions next to the other, over the lesser perimeter."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    near = p.withColumn("s", F.explode(steps)).select("image_id", "y", "x", F.col("label").alias("own"), (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"))
    other = p.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("label").alias("other"))
    touch = near.join(other, ["image_id", "ny", "nx"]).filter("own <> other").groupBy("image_id", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.count_distinct("own", "y", "x").alias("contact"))
    side = lambda k: perimeters.select("image_id", F.col("label").alias(k), F.col("perimeter").alias(f"{k}_p"))
    j = touch.join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"])
    return j.select("image_id", "a", "b", "contact", (F.col("contact") / F.greatest(F.least("a_p", "b_p"), F.lit(1.0))).alias("ratio"))
