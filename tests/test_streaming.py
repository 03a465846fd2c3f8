"""Keyed states on file streams give what the batch operators give."""

import uuid

from pixrel.operators import jobs
from pixrel.streaming import jobs as streams


def run(spark, tmp_path, rows, schema, build, mode):
    src = tmp_path / "in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(src))
    name = f"t{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_job_states_never_fall_and_end(spark, tmp_path):
    schema = "job long, seq long, kind string, stage string, percent int, now_ms long"
    rows = [[(1, 1, "update", "a", 30, 10), (1, 2, "update", "a", 20, 20), (1, 3, "update", "b", 120, 30), (1, 4, "completed", "b", 0, 40), (1, 5, "update", "c", 50, 50), (2, 1, "update", "a", 7, 5)]]
    got = run(spark, tmp_path, rows, schema, streams.job_states, "update").collect()
    final = {r["job"]: (r["status"], r["stage"], r["percent"]) for r in got}
    assert final == {1: ("completed", "completed", 100), 2: ("running", "a", 7)}


def test_admission_on_a_stream_equals_batch(spark, tmp_path):
    rows = [[(c, i, i * 37 + c) for i in range(k, k + 10) for c in (1, 2)] for k in (0,)]
    schema = "client long, seq long, now_ms long"
    got = run(spark, tmp_path, rows, schema, lambda s: streams.admit_stream(s, 100, 2), "append")
    want = jobs.admit(spark.createDataFrame([r for p in rows for r in p], schema), 100, 2)
    cols = ["client", "seq", "now_ms", "admitted"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
