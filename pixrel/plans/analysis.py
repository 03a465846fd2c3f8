"""A whole run: pixels and a configuration in; entities, relationships, tree, correspondence, reconstructions and files out."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixrel.config import RESIDUAL_CANDIDATES, SCHEMA_VERSION, canonical_json, config_hash, resolve
from pixrel.operators import evidence, graph, recon, regions, scales, segmentation, stencil, tree
from pixrel.plans.shared import saved
from pixrel.sources import rasters

#: Kinds of entities by the cut that shows them.
CUTS = ("region", "composite", "entity")


@dataclass
class Run:
    """Tables of a run over any number of images of one size; every table has image_id."""

    config: dict[str, Any]
    width: int
    height: int
    pixels: DataFrame  # features and label of each pixel
    entities: DataFrame  # id, type, level, parent, geometry, appearance, vector
    tree: DataFrame  # node, parent, level, leaves, area, delta_j; with the image's root
    merges: DataFrame  # what happened at each iteration
    cuts: DataFrame  # cut, node, leaves
    relationships: DataFrame  # canonical edges of all families
    matches: DataFrame  # one-to-one matches with each coarser level
    overlaps: DataFrame  # overlap links with each coarser level
    gate: DataFrame  # whether levels were compared
    painted: dict[str, DataFrame]  # reconstructed pixels by name
    measures: DataFrame  # mse, psnr, ssim, error of each reconstruction
    residual: DataFrame  # kept, bytes, payload


def labelled(p: DataFrame, config: dict) -> DataFrame:
    """Feature pixels with the label of their micro-region."""
    return p.drop("label").join(segmentation.segment(p, config).select("image_id", "y", "x", "label"), ["image_id", "y", "x"])


def named(p: DataFrame, names: DataFrame) -> DataFrame:
    """Pixels under the names of larger areas: names has image_id, label and area."""
    return p.join(names, ["image_id", "label"]).withColumn("label", F.col("area")).drop("area")


def table_of(p: DataFrame, kind: str, level: int) -> DataFrame:
    e = evidence.entities(p)
    return e.withColumnsRenamed({"label": "id"}).select(F.lit(kind).alias("type"), F.lit(level).alias("level"), *[c if c != "label" else "id" for c in e.columns])


def edges_between(p: DataFrame, e: DataFrame, width: int, height: int, config: dict, touching: bool) -> DataFrame:
    """Edges of candidate pairs of entities e; contact counts only in the native view."""
    k = config["graphK"]
    small = e.select("image_id", F.col("id").alias("label"), "cx", "cy", "area", "perimeter", "compactness", "orientation", *(f"hu{i}" for i in range(1, 8)), "lab_l", "lab_a", "lab_b", F.col("lightness").alias("brightness"), F.col("local_variance").alias("texture"), F.col("gradient_magnitude").alias("gradient"), F.col("edge_strength").alias("edge_density"), "complexity")
    shared = regions.shared_boundary(p) if touching else small.select("image_id", F.col("label").alias("a"), F.col("label").alias("b"), F.lit(0).cast("long").alias("contacts")).limit(0)
    pairs = graph.candidates(shared, graph.knn(small, ["cx", "cy"], k), graph.knn(small, ["lab_l", "lab_a", "lab_b"], k))
    pairs = pairs.join(shared, ["image_id", "a", "b"], "left").withColumn("contacts", F.coalesce("contacts", F.lit(0)))
    return graph.relationships(pairs, small, width, height, config)


def edge(family: str, rows: DataFrame, views: list[str], **columns: Any) -> DataFrame:  # noqa: ANN401
    """Edges in the form that all families share."""
    shape = {"kinds": "array<string>", "adjacent": "boolean", "normalizedDistance": "double", "affinity": "double", "confidence": "double", "factor": "int"}
    given = lambda c, t: (columns[c] if c in columns else F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
    return rows.select("image_id", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.lit(family).alias("family"), *(given(c, t) for c, t in shape.items()), F.array(*map(F.lit, views)).cast("array<string>").alias("views"))


def analyze(pixels: DataFrame, width: int, height: int, raw: dict[str, Any] | None = None) -> Run:
    """Run every stage over pixels (image_id, y, x, r, g, b) of images of width by height.

    Images are independent: shuffles are by image, and what is sequential inside one (segmentation, merge tree, residual
    file) is a group of its own, which the configured pixel limit bounds; larger images are an error.
    """
    config = resolve(raw)
    if width * height > config["maxImagePixels"]:
        raise ValueError(f"{width * height} pixels exceed the limit of {config['maxImagePixels']}")
    p = saved(labelled(stencil.features(pixels, config["featureWeights"]), config))
    leaves = p.withColumn("label", F.concat(F.lit("region-"), F.col("label").cast("string")))
    grown = saved(tree.merge_tree(p, config))
    rooted = saved(tree.with_root(grown))
    merges = saved(tree.merge_evidence(p, config))

    micro = table_of(leaves, "micro_region", 1)
    up = saved(tree.parent_chains(grown.select("image_id", "node", "parent")).select("image_id", "node", "ancestor").unionByName(grown.select("image_id", "node", F.col("node").alias("ancestor"))))
    inner = grown.filter("delta_j is not null").select("image_id", F.col("node").alias("ancestor"))
    spans = up.join(inner, ["image_id", "ancestor"]).filter("node like 'region-%'").select("image_id", F.col("node").alias("label"), F.col("ancestor").alias("area"))
    merged = table_of(named(leaves, spans), "merge_node", 2).drop("level").join(grown.select("image_id", F.col("node").alias("id"), "level"), ["image_id", "id"])
    whole = table_of(leaves.withColumn("label", F.lit("image-root")), "image", 0).drop("level").join(grown.groupBy("image_id").agg((F.max("level") + 1).alias("level")), "image_id")
    parents = rooted.select("image_id", F.col("node").alias("id"), "parent")
    entities = saved(micro.unionByName(merged).unionByName(whole).join(parents, ["image_id", "id"], "left"))

    linked = rooted.select("image_id", "node", F.when(F.col("parent") != "image-root", F.col("parent")).alias("parent"), "leaves").filter("node <> 'image-root'")
    cuts = None
    for name in CUTS:
        one = tree.derived_cut(linked, config["derivedCutTargetFractions"][name]).select("image_id", F.lit(name).alias("cut"), "node", "leaves")
        cuts = one if cuts is None else cuts.unionByName(one)
    cuts = saved(cuts)

    native = edges_between(leaves, entities.filter("type = 'micro_region'"), width, height, config, True)
    edges = edge("native", native, [])
    for name in CUTS:
        shown = entities.join(cuts.filter(F.col("cut") == name).select("image_id", F.col("node").alias("id")), ["image_id", "id"])
        edges = edges.unionByName(edge("cut", edges_between(leaves, shown, width, height, config, False), [name]))
    inside = tree.contains_edges(rooted).withColumnsRenamed({"source": "a", "target": "b"})
    edges = edges.unionByName(edge("containment", inside, [], kinds=F.array(F.lit("contains"))))

    gate = evidence.scale_gate(p.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels")), config["runScaleConsistency"], config["maxConsistencyPixels"])
    matches, overlaps = correspondence(pixels, p, gate, width, height, config)
    for rows, kind, sure in ((matches, "cross_scale_match", F.col("confidence")), (overlaps, "cross_scale_overlap", F.col("overlapIoU"))):
        ends = rows.withColumns({"a": F.concat(F.lit("region-"), F.col("source").cast("string")), "b": F.concat(F.lit("scale-"), F.col("factor").cast("string"), F.lit("-region-"), F.col("target").cast("string"))})
        edges = edges.unionByName(edge(kind, ends, [], kinds=F.array(F.lit(kind)), confidence=sure))
    payload = [c for c in edges.columns if c not in ("views", "family")]
    relationships = saved(edges.groupBy(*payload).agg(F.min("family").alias("family"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("views")))).alias("views")))

    painted, residual = reconstructions(p, leaves, up, cuts, width, height, config)
    measures = None
    for name, rows in painted.items():
        wrong = recon.channel_error(rows).groupBy("image_id").agg(F.avg(F.col("error") / 3.0).alias("mean_delta"), F.max(F.col("error") / 3.0).alias("max_delta"))
        one = recon.fidelity(rows).join(recon.ssim(rows, width, height), "image_id").join(wrong, "image_id").select("image_id", F.lit(name).alias("name"), "mse", "psnr", "ssim", "mean_delta", "max_delta")
        measures = one if measures is None else measures.unionByName(one)
    return Run(config, width, height, p, entities, rooted.join(grown.select("image_id", "node", "level", "area", "delta_j"), ["image_id", "node"], "left"), merges, cuts, relationships, matches, overlaps, gate, painted, saved(measures), residual)


def correspondence(pixels: DataFrame, p: DataFrame, gate: DataFrame, width: int, height: int, config: dict) -> tuple[DataFrame, DataFrame]:
    """Matches and overlap links of the native regions with those of each coarser level, of images that pass the gate."""
    open_ = gate.filter("status = 'completed'").select("image_id")
    f = saved(p.join(open_, "image_id").select("image_id", "y", "x", "label", "lab_l", "lab_a", "lab_b"))
    matches = overlaps = None
    diagonal = (width * width + height * height) ** 0.5
    side = lambda q: saved(regions.geometry(q).join(q.groupBy(*regions.KEY).agg(*(F.avg(c).alias(c) for c in ("lab_l", "lab_a", "lab_b"))), regions.KEY))
    own = side(f)
    for factor in config["scaleLevels"] if config["runScaleConsistency"] else [1]:
        w, h = (width, height) if factor == 1 else (max(2, width // factor), max(2, height // factor))
        if factor == 1 and len(config["scaleLevels"]) > 1 and config["runScaleConsistency"]:
            continue
        less = config | {"slicSegments": max(8, config["slicSegments"] // (factor * factor)), "minimumRegionPixels": max(1, config["minimumRegionPixels"] // (factor * factor))}
        small = rasters.downscale(pixels.join(open_, "image_id", "left_semi"), factor, width, height) if factor > 1 else pixels.limit(0)
        c = saved(labelled(stencil.features(small, config["featureWeights"]), less).select("image_id", "y", "x", "label", "lab_l", "lab_a", "lab_b"))
        pairs = saved(scales.lifted_pairs(f, c, width, height, w, h))
        m = scales.match_scales(scales.match_costs(pairs, own, side(c), factor, diagonal)).withColumn("factor", F.lit(factor))
        o = scales.overlap_links(pairs, config["crossScaleOverlapThreshold"]).withColumn("factor", F.lit(factor))
        matches, overlaps = (m, o) if matches is None else (matches.unionByName(m), overlaps.unionByName(o))
    return saved(matches), saved(overlaps)


def reconstructions(p: DataFrame, leaves: DataFrame, up: DataFrame, cuts: DataFrame, width: int, height: int, config: dict) -> tuple[dict[str, DataFrame], DataFrame]:
    """Painted pixels: mean colours of each level, fitted surfaces, and these with the residual that its budget allows."""
    out = {"level1": saved(recon.constant(leaves))}
    for k, name in enumerate(CUTS, 2):
        shown = cuts.filter(F.col("cut") == name).select("image_id", F.col("node").alias("ancestor"))
        names = up.join(shown, ["image_id", "ancestor"]).filter("node like 'region-%'").select("image_id", F.col("node").alias("label"), F.col("ancestor").alias("area"))
        out[f"level{k}"] = saved(recon.constant(named(leaves, names)))
    placed = saved(recon.local_coordinates(regions.interior_boundary(p)))
    fits = saved(recon.model_fits(placed).filter(F.col("model").isin(*config["appearanceModelCandidates"])))
    chosen = recon.select_models(fits, recon.boundary_residual(recon.predict(placed, fits)), config["modelPenalty"], config["boundaryLeakagePenalty"])
    # regions too small for any fit are painted in their mean colour
    surface = recon.paint(recon.predict(placed, chosen))
    mean = out["level1"].select("image_id", "y", "x", *(F.col(f"r{c}").alias(f"m{c}") for c in "rgb"))
    surface = mean.join(surface.select("image_id", "y", "x", "rr", "rg", "rb"), ["image_id", "y", "x"], "left").select("image_id", "y", "x", *(F.coalesce(f"r{c}", f"m{c}").alias(f"r{c}") for c in "rgb"))
    out["parametric"] = saved(surface.join(p.select("image_id", "y", "x", "r", "g", "b"), ["image_id", "y", "x"]))
    step, budget = config["residualQuantization"], config["residualBudgetBytes"] if config["residualEnabled"] else 0
    top = saved(recon.top_residuals(recon.residual_candidates(out["parametric"], step), RESIDUAL_CANDIDATES))
    kept = saved(recon.residual_within_budget(top, width, height, step, budget))
    out["residual"] = saved(recon.apply_residual(out["parametric"], top.join(kept.select("image_id", "kept"), "image_id").filter(F.col("rank") <= F.col("kept")), step))
    return out, kept


def artifacts(run: Run) -> DataFrame:
    """image_id, artifact, data: every image file of a run, heat maps and sidecars included. An image is one group."""
    out = run.residual.filter("payload is not null").select("image_id", F.lit("residuals.npz").alias("artifact"), F.col("payload").alias("data"))
    add = lambda name, rows: out.unionByName(rows.select("image_id", F.lit(name).alias("artifact"), "data"))
    for name, rows in run.painted.items():
        wrong = recon.channel_error(rows)
        out = add(f"reconstructions/{name}.png", recon.write_images(rows, ("rr", "rg", "rb")))
        out = add(f"errors/by-reconstruction/{name}.png", recon.write_images(recon.heatmap(wrong), ("hr", "hg", "hb", "alpha")))
        out = add(f"errors/evidence/{name}.delta-rgb.gz", recon.write_images(wrong, ("error",), "sidecar"))
    for field in ("gray", "edge_strength", "complexity"):
        out = add(f"overlays/{field}.png", recon.write_images(overlay(run.pixels, field), ("o0", "o1", "o2")))
    return out


def overlay(p: DataFrame, field: str) -> DataFrame:
    """o0, o1, o2: a field of an image, stretched from its least to its greatest value over the heat map's ramp."""
    ends = p.groupBy("image_id").agg(F.min(field).alias("lo"), F.max(field).alias("hi"))
    t = F.when(F.col("hi") - F.col("lo") <= 1e-9, 0.0).otherwise((F.col(field) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    d = p.join(F.broadcast(ends), "image_id").withColumn("error", t * 96.0)  # a row for each image
    return recon.heatmap(d).select("image_id", "y", "x", F.col("hr").alias("o0"), F.col("hg").alias("o1"), F.col("hb").alias("o2"))


def representation(run: Run) -> DataFrame:
    """image_id, document: a run's evidence of each image as one JSON document, which its limits on regions bound."""
    listed = lambda rows, name, *cols: rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    d = listed(run.entities, "entities", "id", "type", "level", "parent", "area", "vector")
    for rows in (
        listed(run.relationships, "relationships", "a", "b", "kinds", "factor", "confidence", "views"), listed(run.tree, "hierarchy", "node", "parent", "leaves"), listed(run.cuts, "cuts", "cut", "node"),
        listed(run.measures, "reconstruction_metadata", "name", "mse", "psnr", "ssim"), run.gate.select("image_id", F.col("status").alias("correspondence")),
    ):
        d = d.join(rows, "image_id", "left")
    fixed = {"representation_version": SCHEMA_VERSION, "configHash": config_hash(run.config), "configuration": canonical_json(run.config)}
    body = F.struct(*(F.lit(v).alias(k) for k, v in fixed.items()), F.struct(F.lit(run.width).alias("width"), F.lit(run.height).alias("height")).alias("image"), *(c for c in d.columns if c != "image_id"))
    return d.select("image_id", F.to_json(body).alias("document"))


def write_run(run: Run, path: str) -> DataFrame:
    """Write features, documents and artifacts below path; returns the bytes of each artifact."""
    run.pixels.write.partitionBy("image_id").parquet(f"{path}/features")
    for name, rows in (("entities", run.entities), ("relationships", run.relationships), ("tree", run.tree), ("merges", run.merges), ("matches", run.matches), ("overlaps", run.overlaps)):
        rows.write.parquet(f"{path}/{name}")
    representation(run).write.partitionBy("image_id").text(f"{path}/representation")
    files = saved(artifacts(run))
    files.write.partitionBy("artifact").parquet(f"{path}/artifacts")
    return files.select("image_id", "artifact", F.length("data").alias("bytes"))


def svg(p: DataFrame) -> DataFrame:
    """image_id, svg: each region as its rows of pixels, one path a region in its mean colour; an exact outline in integers."""
    runs = p.withColumn("__n", F.coalesce(F.lag("label").over(stencil.by_row()) != F.col("label"), F.lit(True)).cast("int"))
    runs = runs.withColumn("__run", F.sum("__n").over(stencil.by_row()))
    bars = runs.groupBy("image_id", "label", "y", "__run").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n"))
    paths = bars.groupBy("image_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "n"))), lambda b: F.format_string("M%d %dh%dv1h-%dz", b["x"], b["y"], b["n"], b["n"])), "").alias("d"))
    fill = p.groupBy("image_id", "label").agg(*(F.rint(F.avg(c)).cast("int").alias(c) for c in "rgb"))
    shape = F.format_string('<path id="micro-region-%d" d="%s" fill="rgb(%d, %d, %d)"/>', "label", "d", "r", "g", "b")
    lines = paths.join(fill, ["image_id", "label"]).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", shape.alias("s")))).alias("s"))
    size = p.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return lines.join(size, "image_id").select("image_id", F.concat(F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d">', "w", "h"), F.array_join(F.transform("s", lambda v: v["s"]), "\n"), F.lit("</svg>")).alias("svg"))
