import pytest
from pyspark.sql import functions as F

from sagewell.sources import batches

SCHEMA = "site string, hash string, no long"


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def stored(spark, path):
    return sorted((r.site, r.hash, r.no) for r in batches.read_batches(spark, path, SCHEMA).collect())


def put(spark, path, batch, *items):
    return batches.append_batch(spark, path, rows(spark, *items), ["site", "hash"], [F.asc("no")], batch)


def test_first_row_of_a_key_is_kept_over_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert batches.read_batches(spark, path, SCHEMA).count() == 0
    assert put(spark, path, 0, ("a", "x", 2), ("a", "x", 1), ("b", "x", 3)) == 2
    assert put(spark, path, 1, ("a", "x", 0), ("a", "y", 4), ("a", "y", 5)) == 1
    assert put(spark, path, 2, ("a", "y", 9)) == 0
    assert put(spark, path, 3) == 0
    assert stored(spark, path) == [("a", "x", 1), ("a", "y", 4), ("b", "x", 3)]


def test_a_batch_that_died_before_its_commit_is_written_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, 0, ("a", "x", 1))
    with monkeypatch.context() as patch:
        def die(*_):
            raise RuntimeError("killed")

        patch.setattr(batches, "commit_batch", die)
        with pytest.raises(RuntimeError):
            put(spark, path, 1, ("a", "x", 2), ("c", "z", 3))
    assert stored(spark, path) == [("a", "x", 1)]        # written, not committed, not seen
    assert put(spark, path, 1, ("a", "x", 2), ("c", "z", 3)) == 1
    assert put(spark, path, 1, ("a", "x", 2), ("c", "z", 3)) == 1   # comes again after its commit
    assert stored(spark, path) == [("a", "x", 1), ("c", "z", 3)]


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 0, *[(f"s{i}", "x", i) for i in range(200)])
    one = rows(spark, ("s7", "x", 1)).select(F.pmod(F.xxhash64("site", "hash"), F.lit(batches.BUCKETS)).cast("int").alias("b")).first()["b"]
    held = batches.held_keys(spark, path, rows(spark).schema, ["site", "hash"], [one], 0)
    assert {r.b for r in held.select(F.col("_bucket").alias("b")).distinct().collect()} == {one}
    files = held.inputFiles()
    scan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "_bucket" in scan.split("PartitionFilters", 1)[1][:200]
    assert files and 0 < held.count() < 200
