import os

from driftline import session


def test_written_tables_are_in_the_shared_folder_until_discarded(spark):
    df = session.written(spark.range(5).selectExpr("id", "id * 2 as b"), "x")
    (path,) = {os.path.dirname(f) for f in df.inputFiles()}
    assert path.startswith("file:") and session.shared_dir(spark).removeprefix("file:").lstrip("/") in path
    assert df.count() == 5 and df.schema["b"].dataType.typeName() == "long"
    assert session.written(df.where("false"), "y").count() == 0
    session.discard(spark)
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_batches_are_bounded_unless_set(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5m")
    session.modest_batches(spark)
    assert spark.conf.get(key) == "5m"
    spark.conf.unset(key)
    session.modest_batches(spark)
    assert spark.conf.get(key) == "8m"
    spark.conf.set(key, before)
