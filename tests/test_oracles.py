"""Queries against their DuckDB SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from pixrel.plans import queries as raster

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Fast ones of each family; the driver runs the rest.
NAMES = ["raster_embeddings", "raster_lineitem", "upload_preflight", "area_downscale", "gray_hsv", "lab_color", "sobel_edges", "region_statistics", "merged_statistics", "region_geometry", "irregular_shapes", "interior_boundary", "shared_boundary", "knn_spatial", "edge_canonical", "scale_overlap", "nearest_parent", "recon_constant", "mse_psnr", "affine_fit", "residual_topk", "error_heatmap", "derived_cut", "parent_chain", "stage_islands", "admission_window", "in_flight", "manifest_latest", "timing_pivot", "entity_types", "entity_lookup", "member_pixels", "first_edges", "edge_segments", "mutual_contact", "compatible_documents", "progress_lines", "heartbeats", "formatted", "request_headers", "manifest_upsert", "manifest_access", "cache_accesses", "timing_csv", "stage_messages", "eta_range", "failure_receipts", "scale_gate", "match_cost"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, want = raster.QUERIES[name](spark, SF).toPandas(), con.execute(raster.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
