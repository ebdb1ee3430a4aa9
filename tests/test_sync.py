"""A synchronised index is swept of slices that no pointer in force names."""

from lorespan.sources import tables
from lorespan.streaming import sync


def test_sweep(spark, tmp_path):
    schema, index, source = "k int, v int, t string", str(tmp_path / "index"), str(tmp_path / "in")
    for n in range(4):
        spark.createDataFrame([(k, n, f"{k}-{n}") for k in range(n, 12)], schema).coalesce(1).write.mode("append").parquet(source)
        changes = spark.readStream.schema(schema).parquet(source)
        sync.sync_index(changes, index, "k", "v", slices=4).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = {(k, min(k, 3)) for k in range(12)}
    assert {(r.k, r.v) for r in sync.read_index(spark, index, schema).collect()} == want
    assert len(tables.whole_folders(spark, f"{index}/pointers")) == 4
    gone = sync.sweep_index(spark, index)
    assert gone > 0 and len(tables.whole_folders(spark, f"{index}/pointers")) == 2
    assert {(r.k, r.v) for r in sync.read_index(spark, index, schema).collect()} == want
    assert sync.sweep_index(spark, index) == 0 == sync.sweep_index(spark, str(tmp_path / "none"))
