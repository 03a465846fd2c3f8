"""Invariants of the raster engine on small made images."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixrel import config
from pixrel.operators import evidence, jobs, recon, regions, scales, segmentation, stencil, tree
from pixrel.plans import analysis, queries
from pixrel.plans.shared import saved
from pixrel.sources import rasters


@pytest.fixture(scope="module")
def bands(spark):
    p = rasters.generated(spark, 24, 16, rasters.bands(24, perturbed=True))
    return saved(stencil.features(p, config.DEFAULTS["featureWeights"]))


def test_configuration():
    c = config.resolve({"scaleLevels": [4, 2, 2], "featureWeights": {"edge": 0.5}})
    assert c["scaleLevels"] == [1, 2, 4] and c["featureWeights"] == {**config.DEFAULTS["featureWeights"], "edge": 0.5}
    assert len(config.config_hash(c)) == 16 and config.config_hash(c) != config.config_hash(config.resolve())
    with pytest.raises(ValueError, match="slicSegments"):
        config.resolve({"slicSegments": 1})


def test_features_stay_in_range(bands):
    low = bands.agg(*(F.min(c).alias(c) for c in ("complexity", "edge_strength", "local_entropy", "local_variance"))).first()
    high = bands.agg(*(F.max(c).alias(c) for c in ("complexity", "edge_strength", "local_entropy"))).first()
    assert min(low) >= 0 and max(high) <= 1


def test_assignment_is_optimal():
    r = np.random.RandomState(0)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        c = r.rand(n, m).round(2)
        got = sum(c[i, j] for i, j in scales.assignment(c))
        small, t = (c, m) if n <= m else (c.T, n)
        want = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(t), len(small)))
        assert abs(got - want) < 1e-9


def test_merge_tree_is_valid_and_deterministic(spark, bands):
    p = saved(regions.grid_labels(bands, 24, 16, 12))
    t = saved(tree.merge_tree(p, config.resolve({"mergeEnergyThreshold": 0.5})))
    rows = sorted(map(tuple, t.collect()), key=str)
    assert rows == sorted(map(tuple, tree.merge_tree(p.repartition(5), config.resolve({"mergeEnergyThreshold": 0.5})).collect()), key=str)
    v = tree.validity(t, t.select("image_id", "node", "area"), p.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"))).first()
    assert v["valid"] and v["leaf_coverage"] == 1.0 and v["cyclic"] == 0
    level = {r["node"]: r["level"] for r in t.collect()}
    assert all(level[r["node"]] < level[r["parent"]] for r in t.collect() if r["parent"])
    assert tree.with_root(t).filter("parent is null").count() == 1


def test_validity_finds_cycles(spark):
    t = spark.createDataFrame([(0, "a", "b"), (0, "b", "a"), (0, "c", None)], "image_id long, node string, parent string")
    areas = spark.createDataFrame([(0, n, 4) for n in "abc"], "image_id long, node string, area long")
    v = tree.validity(t, areas, spark.createDataFrame([(0, 4)], "image_id long, pixels long")).first()
    assert v["cyclic"] == 2 and not v["valid"]


def greedy_cut(nodes, target):
    kids = {}
    for n, (p, _) in nodes.items():
        kids.setdefault(p, []).append(n)
    cut = list(kids[None])
    while len(cut) < target and (open_ := [n for n in cut if n in kids]):
        n = min(open_, key=lambda k: (-nodes[k][1], k))
        cut.remove(n)
        cut += kids[n]
    return sorted(cut)


def test_derived_cut_equals_greedy_expansion(spark):
    r = random.Random(4)
    parts, nodes, k = [(f"n{i}", 1) for i in range(30)], {}, 30
    while len(parts) > 2:
        (a, x), (b, y) = (parts.pop(r.randrange(len(parts))) for _ in range(2))
        node = f"n{k}"
        nodes[a], nodes[b] = (node, x), (node, y)
        parts.append((node, x + y))
        k += 1
    for n, x in parts:
        nodes[n] = (None, x)
    t = spark.createDataFrame([(0, n, p, x) for n, (p, x) in nodes.items()], "image_id long, node string, parent string, leaves long")
    for fraction in (0.1, 0.25, 0.5, 1.0):
        got = sorted(r["node"] for r in tree.derived_cut(t, fraction).collect())
        assert got == greedy_cut(nodes, max(2, round(30 * fraction)))


def test_components_join_what_touches(spark):
    grid = ["aabba", "abbba", "aaaaa", "bbbbb"]
    p = spark.createDataFrame([(0, y, x, v) for y, row in enumerate(grid) for x, v in enumerate(row)], "image_id long, y int, x int, label string")
    sizes = sorted(r["count"] for r in regions.components(p).groupBy("component").count().collect())
    assert sizes == [5, 5, 10]


def test_residual_fits_its_budget_and_helps(spark, bands):
    p = recon.constant(regions.grid_labels(bands, 24, 16, 4))
    ranked = recon.top_residuals(recon.residual_candidates(p, 2), 1000)
    for budget in (1, 3000, 100_000):
        r = recon.residual_within_budget(ranked, 24, 16, 2, budget).first()
        assert r["bytes"] <= budget and (r["kept"] == 0) == (budget == 1)
    before, after = (recon.fidelity(x).first()["mse"] for x in (p, recon.apply_residual(p, ranked, 2)))
    assert after < before


def test_encoders_round_trip(spark, bands, tmp_path):
    values = np.arange(12, dtype=np.uint16).reshape(3, 4) * 50
    assert np.array_equal(recon.read_sidecar(recon.evidence_sidecar(values)), values)
    data = recon.write_images(bands, ("r", "g", "b")).first()["data"]
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.png").write_bytes(b"no image")
    back = rasters.from_files(spark, str(tmp_path), 10_000)
    want = {(r.y, r.x): (r.r, r.g, r.b) for r in bands.select("y", "x", "r", "g", "b").collect()}
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in back.collect()} == want
    assert rasters.from_files(spark, str(tmp_path), 10).count() == 0


@pytest.mark.parametrize("name", sorted(segmentation.STRATEGIES))
def test_strategies_cover_the_image(spark, bands, name):
    c = config.resolve({"slicSegments": 16, "minimumRegionPixels": 4, "maxInitialSegments": 20})
    s = segmentation.segment(bands, c, name)
    labels = sorted(r["label"] for r in s.select("label").distinct().collect())
    assert s.count() == 24 * 16 and labels == list(range(1, len(labels) + 1)) and len(labels) <= 20


def test_unknown_strategy_is_an_error(bands):
    with pytest.raises(ValueError, match="unknown strategy"):
        segmentation.segment(bands, config.DEFAULTS, "none")


def test_downscale_by_overlap_keeps_constant_images(spark):
    p = rasters.generated(spark, 7, 5, rasters.rgb(9, 99, 200))
    out = rasters.downscale(p, 2, 7, 5).collect()
    assert len(out) == 6 and {(r.r, r.g, r.b) for r in out} == {(9, 99, 200)}


def test_budgets_and_receipts(spark):
    j = spark.createDataFrame([(1, 0, "merge_tree", 130_000, 5_000), (2, 0, "segmentation", 130_000, 5_000), (3, 2, "segmentation", 1, 0), (4, 0, "merge_tree", 130_000, 10_001), (5, 9, "sensitivity", 1, 0), (6, 0, "merge_tree", 400_000, 0)], "job long, variants int, stage string, elapsed long, heartbeat_age long")
    got = {r["job"]: (r["allowance"], r["over"]) for r in jobs.budgets(j).collect()}
    assert got == {1: (150_000, False), 2: (120_000, True), 3: (240_000, False), 4: (120_000, True), 5: (420_000, False), 6: (300_000, True)}


def xxh64_ints(values):
    """Spark's xxhash64 of ints: each hash is the seed of the next."""
    m, rot = 2**64 - 1, lambda v, k: ((v << k) | (v >> (64 - k))) & (2**64 - 1)
    p1, p2, p3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    h = 42
    for v in values:
        h = (h + 0x27D4EB2F165667C5 + 4) & m
        h ^= v * p1 & m
        h = (rot(h, 23) * p2 + p3) & m
        h = (h ^ (h >> 33)) * p2 & m
        h = (h ^ (h >> 29)) * p3 & m
        h ^= h >> 32
    return h


def test_all_made_images_are_returned(spark):
    got = queries.QUERIES["raster_fixtures"](spark, "")
    assert {r["image_id"]: r["count"] for r in got.groupBy("image_id").count().collect()} == dict.fromkeys(range(7), 128 * 96)
    texture = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in got.filter("image_id = 5").collect()}
    assert texture == {(y, x): tuple(xxh64_ints((x, y, k)) % 256 for k in range(3)) for y in range(96) for x in range(128)}
    at = {(r["image_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in got.filter("image_id in (0, 2, 3)").collect()}
    assert at[0, 20, 20] == (220, 60, 50) and at[0, 36, 88] == (50, 110, 220) and at[0, 0, 0] == (240, 240, 235)
    assert at[2, 0, 0] == (120, 190, 240) and at[2, 20, 100] == (250, 220, 80) and at[2, 95, 0] == (140, 100, 60)
    assert at[3, 48, 64] == (230, 90, 30) and at[3, 48, 40] == (20, 40, 120) and at[3, 0, 0] == (255, 255, 255)


def test_every_node_has_its_chain(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["parent_chain"](spark, str(tmp_path)).collect())
    want = [(0, str(k), str(k >> n), n) for k in range(1, 41) for n in range(1, k.bit_length())]
    assert got == sorted(want)


def test_scale_queries_cover_every_level(spark, tmp_path):
    r = random.Random(5)
    spark.createDataFrame([(k, [r.uniform(-1, 1) for _ in range(64)]) for k in range(50)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    cells = lambda w, h, n: {(y, x): min(y * rows // h, rows - 1) * cols + min(x * cols // w, cols - 1) + 1 for rows in [max(1, round((n * h / w) ** 0.5))] for cols in [max(1, -(-n // rows))] for y in range(h) for x in range(w)}
    fine, want = cells(64, 50, 160), {}
    for factor in (2, 4, 8):
        w, h = 64 // factor, 50 // factor
        coarse = cells(w, h, max(8, 160 // factor**2))
        pairs = [(v, coarse[y * h // 50, x * w // 64]) for (y, x), v in fine.items()]
        for a, b in set(pairs):
            share = pairs.count((a, b)) / sum(v == a for v, _ in pairs)
            if share >= 0.2:
                want[factor, 0, a, b] = round(share, 8)
    got = run("scale_overlap")
    assert {(x["factor"], x["image_id"], x["source"], x["target"]): x["finecoverage"] for x in got} == want
    costs, matched = {}, set()
    for x in queries.levels(spark, str(tmp_path), lambda f, c, pairs, k: scales.match_costs(pairs, queries.side(f), queries.side(c), k, queries.DIAGONAL)).collect():
        costs.setdefault(x["factor"], {})[x["source"], x["target"]] = x["cost"]
    assert set(costs) == {2, 4, 8}
    for factor, c in costs.items():
        table = np.array([[c[i, j] for j in sorted({t for _, t in c})] for i in sorted({t for t, _ in c})])
        matched |= {(factor, i + 1, j + 1) for i, j in scales.assignment(table) if table[i, j] <= 0.72}
    assert {(x["factor"], x["source"], x["target"]) for x in run("hungarian_match")} == matched
    assert {x["factor"]: x["matches"] for x in run("correspondence_summary")} == {k: n for k in costs if (n := sum(m[0] == k for m in matched))}
    near = run("nearest_parent")
    assert {x["factor"] for x in near} == {2, 4, 8} and len(near) == 3 * len(set(fine.values()))


def test_sensitivity_reports_the_variants_and_their_measures(spark, tmp_path):
    r = random.Random(6)
    spark.createDataFrame([(k, [r.uniform(-1, 1) for _ in range(64)]) for k in range(50)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x["variant"]: x for x in queries.QUERIES["sensitivity"](spark, str(tmp_path)).collect()}
    assert set(got) == {"coarser_partition", "finer_partition", "conservative_merges", "permissive_merges", "native_scale_only"}
    assert got["coarser_partition"]["micro_regions"] <= got["finer_partition"]["micro_regions"]
    assert got["conservative_merges"]["merge_nodes"] <= got["permissive_merges"]["merge_nodes"] < got["permissive_merges"]["micro_regions"]
    assert all(x["native_relationships"] > 0 and x["residual_bytes"] > 0 and x["mse"] >= 0 and 0 < x["psnr"] <= 99 and x["ssim"] <= 1 for x in got.values())


def test_configuration_is_checked_setting_by_setting():
    assert config.faults({"slicSegments": 181, "scaleLevels": [9], "topology": "8", "residualEnabled": 1, "mergeEnergyWeights": {"rate": 11, "other": 1}, "graphK": 2.5, "appearanceModelCandidates": ["cubic"], "unknown": 1}) != []
    assert len(config.faults({"slicSegments": 181, "graphK": 2.5})) == 2 and config.faults(config.DEFAULTS) == []
    one = config.resolve({"slicCompactness": 5, "x": {"b": 1, "a": [True, None, "ü"]}})
    assert one["slicCompactness"] == 5 and one["x"]["b"] == 1 and config.DEFAULTS["slicCompactness"] == 10.0
    assert config.canonical_json({"b": [1, 2.5], "a": "ü"}) == '{"a":"\\u00fc","b":[1,2.5]}'
    assert set(config.DEFAULTS) == set(config.resolve())


def test_absorb_tiny_equals_brute_force():
    r = np.random.RandomState(2)
    for _ in range(40):
        labels = r.randint(1, 6, (r.randint(2, 9), r.randint(2, 9)))
        least = int(r.randint(1, 8))
        want = labels.copy()
        for k in range(1, 6):
            own = {(int(y), int(x)) for y, x in np.argwhere(want == k)}
            if not own or len(own) >= least:
                continue
            ring = {(y + b, x + a) for y, x in own for b, a in ((0, 1), (0, -1), (1, 0), (-1, 0))} - own
            votes: dict = {}
            for y, x in ring:
                if 0 <= y < labels.shape[0] and 0 <= x < labels.shape[1]:
                    votes[want[y, x]] = votes.get(want[y, x], 0) + 1
            if votes:
                taker = min(votes, key=lambda v: (-votes[v], v))
                for y, x in own:
                    want[y, x] = taker
        assert np.array_equal(segmentation.absorb_tiny(labels, least), np.unique(want, return_inverse=True)[1].reshape(labels.shape) + 1)


def test_residual_file_is_readable_and_its_prefix_the_longest(spark, bands):
    p = recon.constant(regions.grid_labels(bands, 24, 16, 4))
    ranked = saved(recon.top_residuals(recon.residual_candidates(p, 2), 1000))
    rows = sorted(ranked.collect(), key=lambda x: x["rank"])
    r = recon.residual_within_budget(ranked, 24, 16, 2, 1200).first()
    back = recon.read_residual_file(r["payload"])
    kept = sorted((x["y"] * 24 + x["x"], x["qr"], x["qg"], x["qb"]) for x in rows[: r["kept"]])
    assert [(int(i), *map(int, v)) for i, v in zip(back["indices"], back["values"], strict=True)] == kept
    assert back["shape"].tolist() == [16, 24, 3] and back["quantizationStep"].tolist() == [2] and back["values"].dtype == np.int8
    if r["kept"] < len(rows):
        more = sorted((x["y"] * 24 + x["x"], x["qr"], x["qg"], x["qb"]) for x in rows[: r["kept"] + 1])
        assert len(recon.residual_file(indices=[x[0] for x in more], values=[x[1:] for x in more], shape=(16, 24, 3), quantizationStep=[2])) > 1200


def chain_image(spark, labels, edge=0.0):
    rows = [(0, y, x, v, edge, 50.0, 0.0, 0.0, 0.1) for y, row in enumerate(labels) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, label int, edge_strength double, lab_l double, lab_a double, lab_b double, complexity double")


def test_a_chain_of_equal_parts_merges_to_one_root(spark):
    p = chain_image(spark, [[1] * 6 + [2] * 6 + [3] * 6] * 12)
    c = config.resolve({"mergeEnergyThreshold": 1.0, "maxEntityAreaFraction": 1.0})
    t = tree.merge_tree(p, c).collect()
    made = [x for x in t if x["delta_j"] is not None]
    assert len(made) == 2 and [x["leaves"] for x in t if x["parent"] is None] == [3]
    e = tree.merge_evidence(p, c).orderBy("iteration").collect()
    assert [x["accepted"] for x in e] == [True, True] and e[0]["boundary"] == 0.0 and e[0]["rate"] == pytest.approx(-1 / 216)


def test_merges_are_ruled_out_with_their_reason(spark):
    p = chain_image(spark, [[1] * 8 + [2] * 8] * 12, edge=1.0)
    reasons = lambda q, **k: [x["reason"] for x in tree.merge_evidence(q, config.resolve({"maxEntityAreaFraction": 1.0, **k})).collect()]
    assert reasons(p, edgeBarrierThreshold=0.25) == ["edge_barrier"] and reasons(p, edgeBarrierThreshold=1.0, mergeEnergyThreshold=10) == [None]
    assert reasons(p, maxEntityAreaFraction=0.72) == ["max_area"] and reasons(p, edgeBarrierThreshold=1.0, mergeEnergyThreshold=-10) == ["energy_threshold"]
    apart = chain_image(spark, [[1, 2, 3, 1], [1, 2, 3, 1]])
    found = {(x["source"], x["target"]): x["reason"] for x in tree.merge_evidence(apart, config.resolve({"maxEntityAreaFraction": 1.0, "mergeEnergyThreshold": -10})).collect()}
    assert found[("region-1", "region-2")] == found[("region-1", "region-3")] == "not_4_connected" and ("region-2", "region-3") not in found
    c = tree.accepted_merges(tree.merge_evidence(p, config.resolve({"maxEntityAreaFraction": 1.0, "edgeBarrierThreshold": 1.0, "mergeEnergyThreshold": 10}))).first()
    assert (c["accepted"], c["rejected"]) == (1, 0)


def test_stage_messages_follow_the_intervals(spark):
    said = [("a", "one"), ("a", " one "), ("a", ""), ("a", "two"), ("b", ""), ("b", "x  y"), ("a", "one"), *[("c", f"m{i % 9}") for i in range(12)], ("c", "m0")]
    d = spark.createDataFrame([(1, k, s, 0, 100 * k, m) for k, (s, m) in enumerate(said)], "job long, seq long, stage string, percent int, now_ms long, message string")
    got: dict = {}
    for x in sorted(jobs.stage_messages(d).collect(), key=lambda x: (x["island"], x["place"])):
        got.setdefault((x["island"], x["stage"]), []).append((x["text"], x["offset_ms"]))
    assert got[1, "a"] == [("one", 0), ("two", 300)] and got[2, "b"] == [("", 0), ("x y", 100)] and got[3, "a"] == [("one", 0)]
    kept: list = []
    for k in [i % 9 for i in range(12)] + [0]:
        if k not in kept:
            kept = [*kept, k][-8:]
    assert [m for m, _ in got[4, "c"]] == [f"m{k}" for k in kept]
    label = spark.range(1).select(jobs.stage_label(F.lit("merge_tree")).alias("a"), jobs.stage_label(F.lit("own_new_stage")).alias("b")).first()
    assert tuple(label) == ("Energy merge tree", "Own New Stage")


def test_remaining_time_of_studies(spark):
    j = spark.createDataFrame([
        (1, "running", 2, "sensitivity", 90, 100_000, "Running variant 2 of 2"), (2, "running", 5, "segmentation", 20, 60_000, ""), (3, "running", 1, "queued", 0, 0, ""),
        (4, "running", 0, "segmentation", 50, 1, ""), (5, "completed", 2, "sensitivity", 90, 1, ""), (6, "running", 1, "segmentation", 50, 500_000, ""), (7, "running", 1, "segmentation", 50, 177_000, ""),
    ], "job long, status string, variants int, stage string, percent int, elapsed long, message string")
    got = {x["job"]: (x["basis"], x["eta_low"], x["eta_high"]) for x in jobs.eta(j).collect()}
    assert got[1] == ("sensitivity_variant", 21_000, 60_000) and got[2] == ("observed_progress", 144_000, 348_000) and got[3] == ("advanced_budget", 18_000, 60_000)
    assert got[4] == got[5] == got[6] == (None, None, None) and got[7] == ("observed_progress", 5_000, 5_000)


def test_receipts_name_what_the_supervisor_saw(spark):
    rows = [(k, o, "merge_tree", 10, 5, True, True, r) for k, (o, r) in enumerate([("spawn", False), ("silence", False), ("silence", True), ("budget", True), ("exit", True), ("malformed", True), ("other", True), ("cancelled", True)])]
    got = {x["job"]: (x["category"], x["spawned"], x["elapsed_ms"]) for x in jobs.failure_receipts(spark.createDataFrame(rows, "job long, outcome string, stage string, created long, ended long, spawned boolean, heartbeat boolean, ready boolean")).collect()}
    names = ["spawn_failure", "startup_silence", "stage_silence", "process_budget", "engine_exit", "malformed_completion", "unexpected_failure"]
    assert got == {k: (n, n != "unexpected_failure", 0) for k, n in enumerate(names)}


def test_documents_of_unknown_versions_are_errors(spark):
    d = spark.createDataFrame([('{"representation_version": "9.0"}',)], "body string")
    with pytest.raises(Exception, match="Unsupported representation version: 9.0"):
        evidence.read_documents(d).collect()
    with pytest.raises(Exception, match="no entity z"):
        evidence.lookup(spark.createDataFrame([("a", 1)], "id string, v int"), "z").collect()


def test_a_whole_run(spark, tmp_path):
    pixels = saved(rasters.generated(spark, 36, 28, rasters.bands(36, perturbed=True)))
    run = analysis.analyze(pixels, 36, 28, {"scaleLevels": [1, 2], "slicSegments": 18, "slicCompactness": 8, "minimumRegionPixels": 2, "mergeEnergyThreshold": 0.5})
    kinds = {x["type"]: x["count"] for x in run.entities.groupBy("type").count().collect()}
    assert kinds["image"] == 1 and kinds["micro_region"] >= 3
    every = run.entities.collect()
    ids = {x["id"] for x in every}
    assert len(ids) == len(every) and all(x["parent"] is None or x["parent"] in ids for x in every) and all(len(x["vector"]) == 31 for x in every)
    area = {x["id"]: x["area"] for x in every}
    kids: dict = {}
    for x in every:
        if x["parent"]:
            kids.setdefault(x["parent"], []).append(x["area"])
    assert area["image-root"] == 36 * 28 and all(sum(v) == area[k] for k, v in kids.items())
    edges = run.relationships.collect()
    families = {x["family"] for x in edges}
    assert {"native", "containment"} <= families and sum(x["family"] == "containment" for x in edges) == len(every) - 1
    assert len({(x["a"], x["b"], tuple(x["kinds"]), x["confidence"], x["factor"]) for x in edges}) == len(edges)
    m = {x["name"]: x for x in run.measures.collect()}
    assert set(m) == {"level1", "level2", "level3", "level4", "parametric", "residual"} and m["residual"]["mse"] <= m["parametric"]["mse"] and m["level1"]["mse"] <= m["level4"]["mse"]
    assert run.matches.count() > 0 and run.gate.first()["status"] == "completed"
    files = {x["artifact"]: x["bytes"] for x in analysis.write_run(run, str(tmp_path / "run")).collect()}
    assert {"reconstructions/residual.png", "errors/evidence/level1.delta-rgb.gz", "overlays/complexity.png"} <= set(files) and min(files.values()) > 0
    doc = spark.read.text(str(tmp_path / "run/representation")).first()["value"]
    back = evidence.read_documents(spark.createDataFrame([(doc,)], "body string")).first()
    assert back["version"] == config.SCHEMA_VERSION and {x["id"] for x in back["entities"]} == ids
    assert spark.read.parquet(str(tmp_path / "run/features")).count() == 36 * 28
    with pytest.raises(ValueError, match="exceed"):
        analysis.analyze(pixels, 3600, 2800)
    outline = analysis.svg(run.pixels).first()["svg"]
    assert outline.count("<path") == kinds["micro_region"] and sum(int(n) for n in re.findall(r"h(\d+)v1", outline)) == 36 * 28
