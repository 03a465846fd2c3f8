"""Merge trees as parent tables: grouping, energies, cuts, walks and validity."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixrel.operators.segmentation import components
from pixrel.plans.shared import saved


def fixed_groups(entities: DataFrame, size: int) -> DataFrame:
    """Adds parent: chunks of size entities of an image in order of (cy, cx, label)."""
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("cy", "cx", "label"))
    return entities.withColumn("parent", F.floor((order - 1) / size).cast("int"))


def parent_vectors(children: DataFrame, fields: list[str]) -> DataFrame:
    """Parents from children (image_id, parent, area, perimeter, orientation, box and fields): area-weighted means, joint
    box, areas' spread, and the circular mean of orientations."""
    a = F.col("area")
    rad = F.radians("orientation")
    turn = F.pmod(F.degrees(F.atan2(F.sum(a * F.sin(rad)), F.sum(a * F.cos(rad)))), F.lit(360.0))
    return children.groupBy("image_id", "parent").agg(
        F.count(F.lit(1)).alias("children"), F.sum("area").alias("total_area"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
        F.min("area").alias("area_min"), F.max("area").alias("area_max"), F.avg("area").alias("area_mean"), F.var_pop("area").alias("area_variance"),
        (F.sum("area") / F.greatest(F.sum("perimeter"), F.lit(1e-9))).alias("area_per_perimeter"), turn.alias("orientation"), *((F.sum(a * F.col(c)) / F.sum("area")).alias(c) for c in fields))


def lab_energy(stats: str = "") -> Column:
    """Share of the largest CIELAB variance that a region has, from its sufficient statistics."""
    var = lambda c: F.greatest(F.col(f"{stats}sq_{c}") / F.col(f"{stats}count") - (F.col(f"{stats}sum_{c}") / F.col(f"{stats}count")) * (F.col(f"{stats}sum_{c}") / F.col(f"{stats}count")), F.lit(0.0))
    return (var("lab_l") + var("lab_a") + var("lab_b")) / (100.0**2 + 128.0**2 + 128.0**2)


def merge_energies(pairs: DataFrame, stats: DataFrame, image_pixels: int, config: dict) -> DataFrame:
    """Energy of each candidate merge of one round, with the reason that rules it out, if any.

    pairs: image_id, a, b, edge, union_compactness; stats: image_id, label, count, sum_/sq_ of lab_l, lab_a, lab_b and
    complexity, compactness. Statistics of the union are sums of those of its parts.
    """
    names = [c for c in stats.columns if c not in ("image_id", "label")]
    s = stats.select("image_id", F.col("label").alias("a"), *(F.col(c).alias(f"s_{c}") for c in names))
    t = stats.select("image_id", F.col("label").alias("b"), *(F.col(c).alias(f"t_{c}") for c in names))
    j = pairs.join(s, ["image_id", "a"]).join(t, ["image_id", "b"])
    j = j.withColumns({f"u_{c}": F.col(f"s_{c}") + F.col(f"t_{c}") for c in names if c != "compactness"})
    n = F.greatest(F.col("u_count"), F.lit(1))
    weigh = lambda x, y: (F.col("s_count") * x + F.col("t_count") * y) / n
    mean = lambda k: F.col(f"{k}_sum_complexity") / F.col(f"{k}_count")
    j = j.withColumns({
        "deltaDistortion": lab_energy("u_") - weigh(lab_energy("s_"), lab_energy("t_")), "deltaRate": F.lit(-1.0 / max(image_pixels, 1)), "deltaBoundary": F.col("edge"),
        "deltaShape": F.greatest(F.lit(0.0), weigh(F.col("s_compactness"), F.col("t_compactness")) - F.col("union_compactness")), "deltaComplexity": F.greatest(F.lit(0.0), mean("u") - weigh(mean("s"), mean("t"))),
    })
    w = config["mergeEnergyWeights"]
    j = j.withColumn("deltaJ", w["distortion"] * F.col("deltaDistortion") + w["rate"] * F.col("deltaRate") + w["boundary"] * F.col("deltaBoundary") + w["shape"] * F.col("deltaShape") + w["complexity"] * F.col("deltaComplexity"))
    reason = F.when(F.col("u_count") > image_pixels * config["maxEntityAreaFraction"], "max_area").when(F.col("edge") > config["edgeBarrierThreshold"], "edge_barrier").otherwise("ok")
    return j.select("image_id", "a", "b", "deltaDistortion", "deltaBoundary", "deltaShape", "deltaComplexity", "deltaJ", reason.alias("reason"))


def best_merges(energies: DataFrame, threshold: float) -> DataFrame:
    """The accepted merge of each image in one round: least energy, then ids."""
    ok = energies.filter("reason = 'ok'").groupBy("image_id").agg(F.min(F.struct("deltaJ", "a", "b")).alias("m")).select("image_id", "m.*")
    return ok.filter(F.col("deltaJ") <= threshold)


def stable_id(children: list[str], level: int) -> str:
    return "merge-" + hashlib.sha1(("|".join(sorted(children)) + f"|{level}").encode()).hexdigest()[:10]


def _perimeter(mask: np.ndarray) -> float:
    padded = np.pad(mask, 1)
    inner = padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    border = np.pad(mask & ~inner, 1).astype(np.int64)
    cross = border[:-2, 1:-1] + border[2:, 1:-1] + border[1:-1, :-2] + border[1:-1, 2:]
    corner = border[:-2, :-2] + border[:-2, 2:] + border[2:, :-2] + border[2:, 2:]
    code = (border[1:-1, 1:-1] * (1 + 2 * cross + 10 * corner)).ravel()
    weight = np.zeros(64)
    weight[[5, 7, 15, 17, 25, 27]], weight[[21, 33]], weight[[13, 23]] = 1, math.sqrt(2), (1 + math.sqrt(2)) / 2
    return float(weight[code[code > 0]].sum())


#: What a candidate merge is ruled out by, in the order of the tests, and what ends the sequence: fixed values.
MAX_AREA, EDGE_BARRIER, NOT_CONNECTED, ENERGY_THRESHOLD = "max_area", "edge_barrier", "not_4_connected", "energy_threshold"
TREE = "image_id long, node string, parent string, level int, leaves int, area long, delta_j double"
EVIDENCE = "image_id long, iteration int, source string, target string, accepted boolean, reason string, delta_j double, distortion double, rate double, boundary double, shape double, complexity double"
TERMS = ("distortion", "rate", "boundary", "shape", "complexity")


def _whole(mask: np.ndarray) -> bool:
    """Whether a mask is one 4-connected area."""
    return len(np.unique(components(mask.astype(np.int64))[mask])) == 1


def _grow(rows: pd.DataFrame, config: dict) -> tuple[list[tuple], list[tuple]]:
    """Rows of TREE and of EVIDENCE for one image, without its id.

    A pair's energy and verdict depend on the pair alone, so they are kept until one of the two merges. Two connected
    masks that touch make a connected one; only where a leaf lies in several pieces is the union examined.
    """
    rows = rows.sort_values(["y", "x"])  # sums in one order, so that reruns agree to the last bit
    h, w = int(rows["y"].max()) + 1, int(rows["x"].max()) + 1
    at = (rows["y"].to_numpy(), rows["x"].to_numpy())
    grid, edge = np.zeros((h, w), np.int64), np.zeros((h, w))
    grid[at], edge[at] = rows["label"], rows["edge_strength"]
    labels = np.unique(grid)
    names = [f"region-{k}" for k in labels]
    fields = rows[["lab_l", "lab_a", "lab_b"]].to_numpy()
    stat, mask, level, leaves, parent, made, whole = {}, {}, {}, {}, {}, [], {}
    for name, k in zip(names, labels, strict=True):
        own = (rows["label"] == k).to_numpy()
        stat[name] = (int(own.sum()), fields[own].sum(0), (fields[own] ** 2).sum(0), float(rows["complexity"][own].sum()))
        mask[name], level[name], leaves[name] = grid == k, 1, 1
        whole[name] = _whole(mask[name])
    contact: dict[tuple[str, str], list[float]] = {}
    index = np.searchsorted(labels, grid)
    for a, b, ea, eb in ((index[:, :-1], index[:, 1:], edge[:, :-1], edge[:, 1:]), (index[:-1], index[1:], edge[:-1], edge[1:])):
        cut = a != b
        for i, j, x, y in zip(a[cut], b[cut], ea[cut], eb[cut], strict=True):
            c = contact.setdefault(tuple(sorted((names[i], names[j]))), [0.0, 0])
            c[0] += x + y
            c[1] += 2
    compact = lambda m, n: 4 * math.pi * n / max(_perimeter(m) ** 2, 1e-9)
    shape = {n: compact(mask[n], stat[n][0]) for n in names}
    spread = lambda s: float(np.maximum(s[2] / s[0] - (s[1] / s[0]) ** 2, 0).sum() / (100.0**2 + 128.0**2 + 128.0**2))
    weights = config["mergeEnergyWeights"]

    def verdict(a: str, b: str) -> tuple[str | None, float, tuple[float, ...]]:
        """Reason against the merge, or its energy and terms."""
        sa, sb = stat[a], stat[b]
        n = sa[0] + sb[0]
        touch = contact[a, b][0] / contact[a, b][1]
        if n > h * w * config["maxEntityAreaFraction"]:
            return MAX_AREA, math.inf, ()
        if touch > config["edgeBarrierThreshold"]:
            return EDGE_BARRIER, math.inf, ()
        if not (whole[a] and whole[b]) and not _whole(mask[a] | mask[b]):
            return NOT_CONNECTED, math.inf, ()
        u = tuple(x + y for x, y in zip(sa, sb, strict=True))
        mix = lambda x, y: (sa[0] * x + sb[0] * y) / n
        terms = (spread(u) - mix(spread(sa), spread(sb)), -1.0 / (h * w), touch, max(0.0, mix(shape[a], shape[b]) - compact(mask[a] | mask[b], n)), max(0.0, u[3] / n - mix(sa[3] / sa[0], sb[3] / sb[0])))
        return None, sum(weights[k] * v for k, v in zip(TERMS, terms, strict=True)), terms

    known = {p: verdict(*p) for p in contact}
    active, events = set(names), []
    blank = (None,) * len(TERMS)
    for iteration in range(1, config["maxAgglomerationIterations"] + 1):
        if len(active) < 2:
            break
        events += [(iteration, *p, False, v[0], None, *blank) for p, v in sorted(known.items()) if v[0]]
        open_pairs = [(v[1], *p) for p, v in known.items() if not v[0]]
        if not open_pairs:
            break
        best, a, b = min(open_pairs)
        if best > config["mergeEnergyThreshold"]:
            events.append((iteration, None, None, False, ENERGY_THRESHOLD, best, *blank))
            break
        events.append((iteration, a, b, True, None, best, *known[a, b][2]))
        depth = max(level[a], level[b]) + 1
        node = stable_id([a, b], depth)
        stat[node], mask[node] = tuple(x + y for x, y in zip(stat[a], stat[b], strict=True)), mask[a] | mask[b]
        shape[node], level[node], leaves[node], whole[node] = compact(mask[node], stat[node][0]), depth, leaves[a] + leaves[b], True
        parent[a] = parent[b] = node
        active -= {a, b}
        active.add(node)
        made.append((node, best))
        joined: dict[str, list[float]] = {}
        for p in [p for p in contact if a in p or b in p]:
            c = contact.pop(p)
            known.pop(p)
            other = p[0] if p[1] in (a, b) else p[1]
            if other not in (a, b):
                g = joined.setdefault(other, [0.0, 0])
                g[0], g[1] = g[0] + c[0], g[1] + c[1]
        for other, c in joined.items():
            p = tuple(sorted((node, other)))
            contact[p] = c
            known[p] = verdict(*p)
    delta = dict(made)
    return [(n, parent.get(n), level[n], leaves[n], stat[n][0], delta.get(n)) for n in [*names, *(n for n, _ in made)]], events


def _per_image(pixels: DataFrame, config: dict, which: int, schema: str) -> DataFrame:
    """Merging is one sequence inside an image, which its pixel limit bounds: an image is a group, images run in parallel."""
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        image = int(rows["image_id"].iloc[0])
        return pd.DataFrame([(image, *r) for r in _grow(rows, config)[which]], columns=columns)

    need = ["image_id", "y", "x", "label", "edge_strength", "lab_l", "lab_a", "lab_b", "complexity"]
    return pixels.select(*need).groupBy("image_id").applyInPandas(run, schema)


def merge_tree(pixels: DataFrame, config: dict) -> DataFrame:
    """Merge tree of each image: image_id, node, parent, level, leaves, area, delta_j (null for leaves).

    pixels: image_id, y, x, label, edge_strength, lab_l, lab_a, lab_b, complexity.
    """
    return _per_image(pixels, config, 0, TREE)


def merge_evidence(pixels: DataFrame, config: dict) -> DataFrame:
    """What happened at each iteration: merges with their energy terms, pairs ruled out with the reason, and the energy that ended it."""
    return _per_image(pixels, config, 1, EVIDENCE)


def accepted_merges(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("image_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def with_root(tree: DataFrame) -> DataFrame:
    """An image root over all roots of an image's tree (image_id, node, parent, leaves)."""
    roots = tree.filter("parent is null").groupBy("image_id").agg(F.sum("leaves").alias("leaves"))
    linked = tree.select("image_id", "node", F.coalesce("parent", F.lit("image-root")).alias("parent"), F.col("leaves").cast("long").alias("leaves"))
    return linked.unionByName(roots.select("image_id", F.lit("image-root").alias("node"), F.lit(None).cast("string").alias("parent"), "leaves"))


def derived_cut(tree: DataFrame, fraction: float) -> DataFrame:
    """Nodes of a cut of about fraction of the leaves: the largest nodes are expanded first, ties by id.

    A child has fewer leaves than its parent, so the order of expansion is one sort, and the cut a semi-join.
    """
    w = Window.partitionBy("image_id")
    inner = tree.join(tree.select("image_id", F.col("parent").alias("node")).filter("node is not null").groupBy("image_id", "node").agg(F.count(F.lit(1)).alias("grows")), ["image_id", "node"])
    size = tree.groupBy("image_id").agg(F.count_if(F.col("parent").isNull()).alias("roots"), F.sum(F.when(F.col("parent").isNull(), F.col("leaves"))).alias("all_leaves"))
    target = F.greatest(F.col("roots"), F.rint(F.col("all_leaves") * fraction).cast("long"))
    order = inner.join(size, "image_id").withColumn("before", F.coalesce(F.sum(F.col("grows") - 1).over(w.orderBy(F.desc("leaves"), "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opened = order.filter(F.col("roots") + F.col("before") < target).select("image_id", F.col("node").alias("opened"))
    parents = opened.withColumnRenamed("opened", "parent")
    below = tree.filter("parent is null").unionByName(tree.join(parents, ["image_id", "parent"], "left_semi").select(*tree.columns))
    return below.join(opened.withColumnRenamed("opened", "node"), ["image_id", "node"], "left_anti").select("image_id", "node", "leaves")


def parent_chains(tree: DataFrame) -> DataFrame:
    """Every ancestor of every node with its distance: chains known up to a length are joined to the nodes just that far up, so each round doubles their length.

    A recursive query would end at Spark's limits of 100 steps and a million rows. Parents that lead in a circle are an error.
    """
    key = ["image_id", "ancestor"]
    up = saved(tree.filter("parent is not null").select("image_id", "node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "chains")
    length, most = 1, up.count()
    while True:
        top = up.filter(F.col("distance") == length)
        beyond = up.select("image_id", F.col("node").alias("ancestor"), F.col("ancestor").alias("__up"), F.col("distance").alias("__more"))
        more = saved(top.join(beyond, key).select("image_id", "node", F.col("__up").alias("ancestor"), (F.col("distance") + F.col("__more")).alias("distance")), "chains")
        if not more.limit(1).count():
            return up
        if length > most:
            raise ValueError("parents lead in a circle")
        length *= 2
        up = up.unionByName(more)


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """Descendants of every inner node."""
    return parent_chains(tree).groupBy("image_id", F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("height"))


def siblings(tree: DataFrame) -> DataFrame:
    a = tree.select("image_id", "parent", F.col("node").alias("a")).filter("parent is not null")
    return a.join(tree.select("image_id", "parent", F.col("node").alias("b")), ["image_id", "parent"]).filter("a <> b").select("image_id", "a", "b")


def contains_edges(tree: DataFrame) -> DataFrame:
    """A containment edge from each parent to each child."""
    one = F.lit(1.0)
    return tree.filter("parent is not null").select("image_id", F.col("parent").alias("source"), F.col("node").alias("target"), F.lit("contains").alias("kind"), one.alias("ratio"), one.alias("confidence"), F.lit(False).alias("adjacent"))


def validity(tree: DataFrame, areas: DataFrame, image_pixels: DataFrame) -> DataFrame:
    """Per image: share of the pixels in leaves, mean error of parents' areas against their children's, nodes on a cycle.

    tree: image_id, node, parent; areas: image_id, node, area; image_pixels: image_id, pixels. A node that reaches no
    root within as many steps as the tree is deep lies on a cycle; least ancestors double their reach each round.
    """
    tree = tree.select("image_id", "node", "parent")
    t = tree.join(areas, ["image_id", "node"])
    kids = t.filter("parent is not null").groupBy("image_id", F.col("parent").alias("node")).agg(F.sum("area").alias("child_area"))
    errors = t.join(kids, ["image_id", "node"]).groupBy("image_id").agg(F.avg(F.abs(F.col("area") - F.col("child_area")) / F.greatest("area", F.lit(1))).alias("area_error"))
    leaf = t.join(kids, ["image_id", "node"], "left_anti").groupBy("image_id").agg(F.sum("area").alias("leaf_area"))
    reach, hops = tree.select("image_id", "node", "parent"), 1
    while hops < 4096 and reach.filter("parent is not null").limit(1).count():
        step = reach.select("image_id", F.col("node").alias("parent"), F.col("parent").alias("__far"))
        reach = reach.join(step, ["image_id", "parent"], "left").select("image_id", "node", F.col("__far").alias("parent"))
        reach = saved(reach)
        hops *= 2
    loops = reach.groupBy("image_id").agg(F.count("parent").alias("cyclic"))
    out = image_pixels.join(leaf, "image_id", "left").join(errors, "image_id", "left").join(loops, "image_id", "left")
    cover = F.coalesce(F.col("leaf_area"), F.lit(0)) / F.col("pixels")
    out = out.select("image_id", cover.alias("leaf_coverage"), F.coalesce("area_error", F.lit(0.0)).alias("area_error"), F.coalesce("cyclic", F.lit(0)).alias("cyclic"))
    return out.withColumn("valid", (F.col("leaf_coverage") == 1.0) & (F.col("area_error") <= 1e-9) & (F.col("cyclic") == 0))
