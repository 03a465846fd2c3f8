"""What the usual tables don't have: deep trees, ties of rounding, images with missing rows, shuffles that pile up."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from pixrel.llm import jaccard
from pixrel.operators import tree
from pixrel.plans import queries, run_queries  # noqa: F401
from pixrel.plans.shared import CLEANUP, saved

duckdb = pytest.importorskip("duckdb")


def differences(spark, path, name):
    """Rows that only Spark has and rows that only the SQL has, over the tables in path."""
    con = duckdb.connect()
    for f in os.listdir(path):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}/{f}/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(path)).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    one, two = ({repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in f[sorted(f.columns)].itertuples(index=False, name=None)} for f in (got, want))
    return one - two, two - one


def path_tree(spark, n):
    """Node k has parent k - 1."""
    return spark.range(n).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))


def test_chains_beyond_a_hundred_steps(spark):
    got = {(int(r["node"]), int(r["ancestor"])): r["distance"] for r in tree.parent_chains(path_tree(spark, 150)).collect()}
    assert got == {(i, j): i - j for i in range(150) for j in range(i)}


def test_subtrees_beyond_a_hundred_steps(spark):
    got = {int(r["node"]): (r["descendants"], r["height"]) for r in tree.subtree_sizes(path_tree(spark, 150)).collect()}
    assert got == {i: (149 - i, 149 - i) for i in range(149)}


def test_trees_of_keys_with_gaps_and_repeats(spark, tmp_path):
    keys = [*range(30), *range(1000, 1030), *range(1000, 1010), None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert differences(spark, tmp_path, "subtree_sizes") == (set(), set())


def test_parents_in_a_circle_are_an_error(spark):
    with pytest.raises(ValueError, match="circle"):
        tree.parent_chains(spark.createDataFrame([(0, "a", "b"), (0, "b", "a"), (0, "c", "a")], "image_id long, node string, parent string"))


def test_ties_of_bytes_are_rounded_as_in_sql(spark, tmp_path):
    prices = [178.5, 452.5, 690.5, 964.5, 1202.5, 1476.5, 100.25, 20.5, 21.5]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert differences(spark, tmp_path, "formatted") == (set(), set())


@pytest.mark.parametrize("name", ["match_cost", "nearest_parent", "pixel_features"])
def test_images_with_missing_rows(spark, tmp_path, name):
    r = random.Random(8)
    spark.createDataFrame([(k, [r.uniform(-1, 1) for _ in range(64)]) for k in range(56)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert differences(spark, tmp_path, name) == (set(), set())


def test_a_saved_table_leaves_no_shuffle_behind(spark):
    spark.conf.unset(CLEANUP)
    spark._jvm.System.gc()
    blocks = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle" in x}
    before = blocks()
    kept = saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(50):
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before
    assert spark.conf.get(CLEANUP) == "false"
    assert kept.agg(F.sum("n")).first()[0] == 1000


@pytest.mark.parametrize("odd", [[], [(5, "w2 a b c d e f g h"), (5, "another text of six words here"), (None, "a text without an id"), (None, None)]])
def test_near_duplicates_shuffle_texts_once(spark, tmp_path, odd):
    rows = [(i, f"w{i // 2} a b c d e f g h") for i in range(100)]
    spark.createDataFrame(rows + odd, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("FileScan" in line and "text#" in line for line in plan.split("\n")) == 1
    assert len(got) == len({g["text"] for g in got}) == 50 + len(odd[1:])
