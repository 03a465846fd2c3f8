"""Queries over whole runs and their evidence, with DuckDB SQL where it can state the result."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixrel.functions import text
from pixrel.operators import evidence, jobs, regions, tree
from pixrel.plans import analysis
from pixrel.plans import oracle as O
from pixrel.plans.queries import DEFAULTS, HEAP, H, W, edge_rows, featured, heap_tree, labelled, manifest, pixels, query, rounded, scale_overlap, table
from pixrel.plans.queries import MAN as MANIFEST
from pixrel.sources import rasters


# --- runs ------------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=4)
def run_of(spark: SparkSession, d: str) -> analysis.Run:
    """One run of a session over a folder: its tables are saved, so the queries that read it share it."""
    return analysis.analyze(pixels(spark, d), W, H, {"scaleLevels": [1, 2, 4, 8]})


@query()
def analysis_entities(spark, d):
    """Every entity of every image: micro-regions, merge nodes and the image, with the vector of 31 values."""
    return run_of(spark, d).entities.select("image_id", "id", "type", "level", "parent", "area", "vector")


@query()
def analysis_relationships(spark, d):
    """Edges of all families in canonical form: native, of the three cuts, containment, matches and overlaps across scales."""
    return run_of(spark, d).relationships


@query()
def analysis_measures(spark, d):
    """Fidelity of the level, parametric and residual reconstructions of each image."""
    return rounded(run_of(spark, d).measures, "mse", "psnr", "ssim", "mean_delta", "max_delta")


@query()
def analysis_documents(spark, d):
    return analysis.representation(run_of(spark, d))


@query()
def analysis_artifacts(spark, d):
    """Bytes of every file of a run."""
    return analysis.artifacts(run_of(spark, d)).select("image_id", "artifact", F.length("data").alias("bytes"))


@query()
def analysis_fixtures(spark, d):
    """Whole runs over the seven made images of 128 by 96 pixels: what published runtimes are of."""
    run = analysis.analyze(rasters.fixtures(spark), 128, 96)
    return rounded(run.measures, "mse", "psnr", "ssim", "mean_delta", "max_delta")


@query()
def merge_evidence(spark, d):
    p = regions.grid_labels(featured(spark, d), W, H, 40)
    return tree.merge_evidence(p, DEFAULTS)


@query()
def accepted_merges(spark, d):
    return tree.accepted_merges(merge_evidence(spark, d))


@query()
def svg_regions(spark, d):
    return analysis.svg(labelled(pixels(spark, d)))


# --- entities --------------------------------------------------------------------------------------------------------
FIELDS = {"red": "r / 255.0", "green": "g / 255.0", "blue": "b / 255.0", "lab_l": "lab_l", "lab_a": "lab_a", "lab_b": "lab_b", "gradient_magnitude": "edge_strength", "edge_strength": "edge_strength", "local_variance": "local_variance", "local_entropy": "local_entropy", "complexity": "complexity"}
VARIANCES = ("red", "green", "blue", "lab_l", "gradient_magnitude")


@query(f"""{O.FEATURES}, l as (select *, {O.CELL} from ft), {O.geometry('l')}, {O.perimeter('l')}, s as (select image_id, label, {', '.join(f'avg({v}) {k}' for k, v in FIELDS.items())}, {', '.join(f'var_pop({FIELDS[k]}) v_{k}' for k in VARIANCES)} from l group by image_id, label)
select image_id, label, {', '.join(f'round({c}, 8) + 0.0 {c}' for c in (*FIELDS, *(f'v_{k}' for k in VARIANCES)))}, round(cx, 6) cx, round(cy, 6) cy, max_x - min_x + 1 width, max_y - min_y + 1 height, area, round(perimeter, 6) perimeter from s join ge using (image_id, label) join pe using (image_id, label)""")
def entity_vectors(spark, d):
    e = evidence.entities(labelled(featured(spark, d)))
    at = {n: F.element_at("vector", evidence.VECTOR.index(n) + 1) for n in FIELDS} | {f"v_{n}": F.element_at("vector", evidence.VECTOR.index(f"var_{n}") + 1) for n in VARIANCES}
    return e.select("image_id", "label", *((v + 0.0).alias(k) for k, v in at.items()), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "width", "height", "area", F.round("perimeter", 6).alias("perimeter"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The heap tree's nodes as entities with their types."""
    kind = F.when(F.col("parent").isNull(), "image").when(F.col("leaves") == 1, "micro_region").otherwise("merge_node")
    return heap_tree(spark, d).select("image_id", F.col("node").alias("id"), kind.alias("type"), F.length(F.bin(F.col("node").cast("long"))).alias("level"), "parent", "leaves")


NODES = f"{HEAP}, en as (select image_id, node id, case when parent is null then 'image' when leaves = 1 then 'micro_region' else 'merge_node' end \"type\", length(bin(node::bigint)) \"level\", parent, leaves from t)"


@query(f"{NODES} select image_id, \"type\", count(*) entities from en group by all")
def entity_types(spark, d):
    return evidence.by_type(nodes(spark, d))


@query(f"{NODES} select id, \"type\", \"level\"::int \"level\", parent parent_id from en")
def hierarchy_view(spark, d):
    return evidence.hierarchy(nodes(spark, d))


@query(f"{NODES} select image_id, min(id) filter (\"type\" = 'micro_region') id from en group by image_id")
def default_entity(spark, d):
    return evidence.default_entity(nodes(spark, d))


@query(f"{NODES} select id, \"type\", leaves from en where id = '7'")
def entity_lookup(spark, d):
    return evidence.lookup(nodes(spark, d), "7").select("id", "type", "leaves")


@query(f"{O.LABELS} select image_id, label, string_agg(x * 2 || ':' || y * 2, ',' order by y, x) pixels from l group by image_id, label")
def member_pixels(spark, d):
    m = evidence.member_pixels(labelled(pixels(spark, d)), 2)
    return m.select("image_id", "label", F.array_join(F.transform("pixels", lambda v: F.concat_ws(":", v[0].cast("string"), v[1].cast("string"))), ",").alias("pixels"))


@query(f"{O.FEATURES}, q as (select image_id, avg(complexity) m, quantile_cont(complexity, 0.75) u from ft group by image_id) select image_id, round(m, 6) mean, round(u, 6) \"upper\", least(180, greatest(8, round_even(72 * (0.5 + m + u), 0)::int)) segments from q")
def adaptive_segments(spark, d):
    return rounded(evidence.adaptive_segments(featured(spark, d)), "mean", "upper")


# --- edges -----------------------------------------------------------------------------------------------------------
@query(f"{O.RELATIONS}, rc as (select image_id, count(*) k from rel group by image_id), nn as (select image_id, count(*) n from en2 group by image_id) select image_id, round(coalesce(k, 0) / n, 8) density from nn left join rc using (image_id)")
def relationship_density(spark, d):
    e = edge_rows(spark, d)
    return evidence.density(e, regions.geometry(labelled(pixels(spark, d))))


@query(f"{O.RELATIONS}, ev as (select image_id, a entity, a, b, round(conf, 8) c from rel union all select image_id, b, a, b, round(conf, 8) from rel), k as (select *, row_number() over (partition by image_id, entity order by c desc, a, b) place from ev) select image_id, entity, count(*) edges, round(max(c), 5) strongest, round(min(c), 5) weakest from k where place <= 8 group by image_id, entity")
def first_edges(spark, d):
    e = evidence.first_edges(edge_rows(spark, d))
    return e.groupBy("image_id", "entity").agg(F.count(F.lit(1)).alias("edges"), F.round(F.max("confidence"), 5).alias("strongest"), F.round(F.min("confidence"), 5).alias("weakest"))


@query(f"{O.LABELS}, {O.geometry('l')}, {O.contacts('l')}, sb as (select distinct image_id, a, b from ct) select sb.image_id, a, b, round_even(s.cx, 0)::int x1, round_even(s.cy, 0)::int y1, round_even(t.cx, 0)::int x2, round_even(t.cy, 0)::int y2, '70,230,70' rgb from sb join ge s on s.image_id = sb.image_id and s.label = a join ge t on t.image_id = sb.image_id and t.label = b where a <> 3 and b <> 3")
def edge_segments(spark, d):
    """Lines of the contact graph; the ends of region 3 are missing on purpose, and so are its edges."""
    p = labelled(pixels(spark, d))
    e = regions.geometry(p).filter("label <> 3").select("image_id", F.col("label").alias("id"), F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"))
    lines = evidence.segments(evidence.endpoints(regions.shared_boundary(p).withColumns({"adjacent": F.lit(True), "normalizedDistance": F.lit(0.0)}), e))
    return lines.withColumn("rgb", F.array_join(F.transform("rgb", lambda v: v.cast("string")), ","))


@query(f"{O.LABELS}, {O.perimeter('l')}, nb as (select l.image_id, l.y, l.x, l.label own, m.label other from l join l m on m.image_id = l.image_id and abs(m.x - l.x) + abs(m.y - l.y) = 1 where m.label <> l.label), q as (select image_id, least(own, other) a, greatest(own, other) b, count(distinct (own, y, x)) contact from nb group by all) select q.image_id, a, b, contact, round(contact / greatest(least(s.perimeter, t.perimeter), 1.0), 6) ratio from q join pe s on s.image_id = q.image_id and s.label = a join pe t on t.image_id = q.image_id and t.label = b")
def mutual_contact(spark, d):
    p = labelled(pixels(spark, d))
    return rounded(evidence.mutual_contact(p, regions.perimeter(p)), "ratio")


@query(f"{O.LABELS}, mc as (select image_id, label, avg(r) r, avg(g) g, avg(b) b from l group by image_id, label) select s.image_id, s.label a, t.label b, round(1 - sqrt((s.r - t.r) * (s.r - t.r) + (s.g - t.g) * (s.g - t.g) + (s.b - t.b) * (s.b - t.b)) / sqrt(3 * 255.0 * 255.0), 6) similarity from mc s join mc t on s.image_id = t.image_id and t.label = s.label + 1")
def linear_colour_similarity(spark, d):
    m = labelled(pixels(spark, d)).groupBy("image_id", "label").agg(*(F.avg(c).alias(c) for c in "rgb"))
    t = m.select("image_id", (F.col("label") - 1).alias("label"), *(F.col(c).alias(f"t{c}") for c in "rgb"))
    j = m.join(t, ["image_id", "label"])
    s = evidence.legacy_similarity([F.col(c) for c in "rgb"], [F.col(f"t{c}") for c in "rgb"])
    return j.select("image_id", F.col("label").alias("a"), (F.col("label") + 1).alias("b"), F.round(s, 6).alias("similarity"))


@query("select s_suppkey image_id, s_nationkey * 50000 pixels, case when s_nationkey * 50000 > 786432 then 'skipped_pixel_limit' else 'completed' end status from supplier")
def scale_gate(spark, d):
    return evidence.scale_gate(table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_nationkey") * 50_000).alias("pixels")), True, 786_432)


# --- documents, lines and text -----------------------------------------------------------------------------------------
VERSIONS = ("0.2.0", "0.3.0", "0.4.0", "0.5.0", "0.6.0", "0.7.0")


@query("""with v as (select p_partkey k, ['0.2.0', '0.3.0', '0.4.0', '0.5.0', '0.6.0', '0.7.0'][(p_partkey % 6)::int + 1] v from part)
select k, v "version", case when v = '0.4.0' then case when k % 5 = 0 then 'match-' || k else 'parent-' || k end when k % 5 = 0 then 'match-' || k end matched, ['legacy-v0.2', 'native-v0.3', 'native-v0.4-with-correspondence-alias', 'native-v0.5', 'native-v0.6', 'native-v0.7'][(k % 6)::int + 1] compatibility from v""")
def compatible_documents(spark, d):
    """Documents of all versions, read as one view; version 0.4 told matches as parents."""
    k = F.col("p_partkey")
    version = F.element_at(F.array(*map(F.lit, VERSIONS)), (k % 6 + 1).cast("int"))
    own = F.when(k % 5 == 0, F.concat(F.lit("match-"), k.cast("string")))
    body = F.to_json(F.struct(version.alias("representation_version"), F.array(F.struct(F.lit("e").alias("id"), F.concat(F.lit("parent-"), k.cast("string")).alias("crossScaleParentId"), own.alias("crossScaleMatchId"))).alias("entities")))
    r = evidence.read_documents(table(spark, d, "part").select(k.alias("k"), body.alias("body")))
    return r.select("k", "version", F.col("entities")[0]["crossScaleMatchId"].alias("matched"), "compatibility")


@query("select event_id k, event_type stage, (event_id % 100)::double percent, '' message from events where event_id % 4 <> 0")
def progress_lines(spark, d):
    """Reports from lines; every fourth line is broken off."""
    k = F.col("event_id")
    line = F.to_json(F.struct(F.col("event_type").alias("stage"), (k % 100).alias("percent")))
    return evidence.progress_lines(table(spark, d, "events").select(k.alias("k"), F.when(k % 4 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")))


@query("select event_id k, least(63, 51 + floor(12 * least(event_id % 90, 80) / 80.0))::int merging, least(93, 89 + floor(4 * least(value / 400, 1.0)))::int nested from events")
def mapped_percent(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(k.alias("k"), evidence.merge_percent(k % 90, F.lit(80)).alias("merging"), evidence.nested_percent(F.col("value") / 400).alias("nested"))


@query(f"""{O.JOBS}, q as (select job, seq, now_ms, stage = 'error' forced from pr), a as (select *, max(case when forced then now_ms end) over (partition by job order by now_ms, seq rows unbounded preceding) anchor from q),
s as (select *, (now_ms - coalesce(anchor, 0)) // 3600000 slot from a), k as (select *, row_number() over (partition by job, anchor, slot order by forced desc, now_ms, seq) n from s) select job, seq, now_ms, forced from k where forced or (n = 1 and (slot > 0 or anchor is null))""")
def heartbeats(spark, d):
    e = jobs.progress_from_events(table(spark, d, "events"))
    return evidence.heartbeats(e.select("job", "seq", "now_ms", (F.col("stage") == "error").alias("forced")), 3_600_000)


@query("""with o as (select o_orderkey k, (o_totalprice * 37)::bigint n from orders)
select k, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', floor(n / 1024.0::double * 10 + 0.5) / 10) else printf('%.2f MB', floor(n / 1048576.0::double * 100 + 0.5) / 100) end size, case when floor(n / 1000.0 + 0.5) < 60 then floor(n / 1000.0 + 0.5)::bigint || 's' else floor(floor(n / 1000.0 + 0.5) / 60)::bigint || 'm ' || (floor(n / 1000.0 + 0.5)::bigint % 60) || 's' end duration from o""")
def formatted(spark, d):
    n = F.rint(F.col("o_totalprice") * 37).cast("long")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.bytes_format(n).alias("size"), text.duration_format(n).alias("duration"))


@query("""with c as (select c_custkey k, case when c_custkey % 3 = 0 then 'short' else lpad(c_custkey::varchar, 24, 'v') end id from customer)
select k, case when k % 3 <> 0 then id end visitor, case when k % 4 <> 0 then '10.0.0.' || (k % 250) end address, case when k % 5 = 0 then 7 else k end number from c""")
def request_headers(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "short").otherwise(F.lpad(k.cast("string"), 24, "v"))
    cookies = F.concat(F.lit("theme=dark; visitor="), name, F.lit("; lang=en"))
    forwarded = F.when(k % 4 != 0, F.concat(F.lit(" 10.0.0."), (k % 250).cast("string"), F.lit(", 192.0.2.1")))
    number = F.when(k % 5 == 0, "-3").otherwise(F.concat(k.cast("string"), F.lit("ms")))
    return table(spark, d, "customer").select(k.alias("k"), text.visitor(cookies, "visitor").alias("visitor"), text.forwarded_for(forwarded).alias("address"), text.positive_integer(number, 7).alias("number"))


# --- manifest, cache and exports -----------------------------------------------------------------------------------------
@query(f"with {MANIFEST}, x as (select * from mf qualify row_number() over (partition by job order by updated desc, seq desc) = 1) select job, owner, case when job % 10 = 0 then 'completed' else status end status, case when job % 10 = 0 then updated + 5 else updated end updated, payload from x union all select 1000000, 1, 'completed', 5, null")
def manifest_upsert(spark, d):
    """Every tenth job is completed by a later write that has no payload, and one job is new."""
    m = jobs.latest(manifest(spark, d))
    later = m.filter("job % 10 = 0").select("job", "seq", F.lit("completed").alias("status"), (F.col("updated") + 5).alias("updated"))
    new = spark.range(1).select(F.lit(1_000_000).cast("long").alias("job"), F.lit(1).cast("long").alias("seq"), F.lit("completed").alias("status"), F.lit(5).cast("long").alias("updated"), F.lit(1).cast("long").alias("owner"))
    return jobs.upsert(m, later.unionByName(new, allowMissingColumns=True)).select("job", "owner", "status", "updated", "payload")


@query(f"with {MANIFEST}, x as (select * from mf qualify row_number() over (partition by job order by updated desc, seq desc) = 1) select job, owner, status from x where job = 8")
def manifest_read(spark, d):
    return jobs.point_read(jobs.latest(manifest(spark, d)), 8).select("job", "owner", "status")


@query(f"with {MANIFEST}, x as (select * from mf qualify row_number() over (partition by job order by updated desc, seq desc) = 1) select job, case when status = 'running' then 'failed' when status = 'completed' and expires <= 900000000000 then 'expired' else status end status, status = 'completed' and expires > 900000000000 result_available from x")
def manifest_restored(spark, d):
    return jobs.restored(jobs.latest(manifest(spark, d)), 900_000_000_000).select("job", "status", "result_available")


@query(f"with {MANIFEST}, x as (select * from mf qualify row_number() over (partition by job order by updated desc, seq desc) = 1) select job, case when owner <> 3 then 'not_found' when expires <= 900000000000 then 'expired' when status <> 'completed' then 'not_ready' when job % 2 = 0 then 'cache' else 'store' end access from x")
def manifest_access(spark, d):
    m = jobs.latest(manifest(spark, d))
    return jobs.access(m, m.filter("job % 2 = 0").select("job"), 3, 900_000_000_000)


@query(f"{O.JOBS}, q as (select job \"key\", seq, now_ms, case when stage in ('click', 'purchase') then 'put' else 'get' end op from pr), s as (select *, max(case when op = 'put' then now_ms end) over (partition by \"key\" order by now_ms, seq rows between unbounded preceding and 1 preceding) st from q) select \"key\", seq, op, op = 'get' and coalesce(now_ms - st < 86400000, false) hit, op = 'get' and coalesce(now_ms - st >= 86400000, false) expired from s")
def cache_accesses(spark, d):
    e = jobs.progress_from_events(table(spark, d, "events"))
    return jobs.snapshots(e.select(F.col("job").alias("key"), "seq", "now_ms", F.when(F.col("stage").isin("click", "purchase"), "put").otherwise("get").alias("op")), 86_400_000).select("key", "seq", "op", "hit", "expired")


def records(spark: SparkSession, d: str) -> DataFrame:
    """A timing record of each job, with its stages in order."""
    i = jobs.stage_islands(jobs.progress_from_events(table(spark, d, "events")))
    stages = F.array_sort(F.collect_list(F.struct("island", F.col("stage").alias("label"), "duration")))
    r = i.groupBy("job").agg(F.max("ended").alias("completed"), F.sum("duration").alias("total"), stages.alias("stages"))
    return r.withColumns({"owner": F.col("job") % 5, "segmentation": F.lit('sl"ic')})


STAGES = ("click", "view")


@query(f"""{O.ISLANDS}, f as (select job, max(ended) e, sum(duration)::bigint total from isl group by job), g as (select job, stage, arg_max(duration, island) v from isl group by job, stage)
select f.job, '"' || f.job || '","' || strftime(make_timestamp(e * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","sl""ic","' || total || '","' || coalesce((select v from g where g.job = f.job and stage = 'click'), 0) || '","' || coalesce((select v from g where g.job = f.job and stage = 'view'), 0) || '"' line from f""")
def timing_csv(spark, d):
    return jobs.timing_csv(records(spark, d), list(STAGES))


@query()
def timing_json(spark, d):
    return jobs.timing_json(records(spark, d))


@query(f"{O.JOBS} select distinct stage from pr")
def stage_names(spark, d):
    return records(spark, d).select(F.explode("stages").alias("s")).select(F.col("s.label").alias("stage")).distinct()


@query("with s as (select distinct s_nationkey % 3 g, case s_nationkey % 3 when 0 then 'slic' when 1 then 'watershed' else 'felzenszwalb' end strategy from supplier) select g, strategy from s")
def distinct_strategies(spark, d):
    g = F.col("s_nationkey") % 3
    return table(spark, d, "supplier").select(g.alias("g"), F.when(g == 0, "slic").when(g == 1, "watershed").otherwise("felzenszwalb").alias("strategy")).dropDuplicates()


@query("select l_returnflag artifact, sum(l_quantity)::bigint bytes, count(*) files from lineitem group by l_returnflag")
def artifact_bytes(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("artifact")).agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("files"))


@query("select c_custkey k, c_nationkey nation from customer")
def public_view(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("error_evidence"))
    return evidence.public(c)


@query(f"with {O.LEVELS_SQL.removeprefix('with ')}, k as (select * from lp where common / source_area >= 0.2 and source = 7) select factor, image_id, source, target from k qualify row_number() over (partition by image_id order by factor, source, target) = 1")
def cross_scale_link(spark, d):
    """For region 7 of every image the first link that has it as its finer end."""
    links = scale_overlap(spark, d).filter("source = 7")
    first = links.groupBy("image_id").agg(F.min(F.struct("factor", "source", "target")).alias("m"))
    return first.select("m.factor", "image_id", "m.source", "m.target")
