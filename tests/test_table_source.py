"""Exported log lines as a table source: ranges, columns, lines that are no entry, streams."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.session import scratch
from millrace.sources import sinks, tables


@pytest.fixture(scope="module")
def reader(spark):
    tables.register(spark)
    return lambda **options: spark.read.format(tables.FORMAT).options(**options)


@pytest.fixture(scope="module")
def entries(spark):
    rows = spark.range(3000).repartition(3).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "ERROR").otherwise("INFO").alias("level"), F.lit("s").alias("service"), F.col("id").cast("string").alias("task_id"),
        F.lit(None).cast("string").alias("pipeline_id"), F.lit("n").alias("node_id"),
        F.concat(F.lit('größe "x", '), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int"))).alias("message"),
    )
    return rows.cache()


def texts(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("form", ["json", "csv"])
@pytest.mark.parametrize("size", [1, 10_000, 1 << 25])
def test_every_line_lies_in_one_range(spark, reader, entries, form, size):
    path = scratch(spark, "lines")
    few = entries.where("task_id % 100 = 0") if size == 1 else entries
    sinks.export_logs(few.coalesce(1) if size == 1 else few, path, form)
    if size == 1:  # a partition for each byte of one short file
        path_size = sum(f.size for f in tables._files(path))
        parts = tables.ranges(tables._files(path), 1)
        assert len(parts) == path_size
        system = tables._system(path)[0]
        assert sum(len(list(tables._lines(system, p))) for p in parts) == few.count() + (form == "csv")
        return
    back = reader(lines=form, rangeBytes=size).load(path)
    assert texts(back.drop("malformed")) == texts(few)
    assert back.where("malformed").count() == 0
    if size == 10_000:
        assert back.rdd.getNumPartitions() > 10


def test_only_the_columns_asked_for(spark, reader, entries):
    path = scratch(spark, "lines")
    sinks.export_logs(entries, path)
    back = reader().schema("message string, level string").load(path)
    assert back.columns == ["message", "level"]
    assert texts(back) == texts(entries.select("message", "level"))
    assert reader().load(path).where("level = 'ERROR'").count() == 1000
    with pytest.raises(Exception, match="has no column nothing"):
        reader().schema("nothing string").load(path).collect()


def test_lines_that_are_no_entry_stay(spark, reader):
    path = scratch(spark, "lines")
    good = json.dumps({"timestamp": "2024-01-01T01:00:00+01:00", "level": "INFO", "message": {"k": 1}})
    spark.createDataFrame([(x,) for x in (good, "no entry", "", "[1]", '{"timestamp": "soon"}', "{}")], "line string").coalesce(1).write.text(path)
    rows = reader().load(path).collect()
    assert [(r["malformed"], r["message"]) for r in rows] == [
        (False, '{"k": 1}'), (True, "no entry"), (True, ""), (True, "[1]"), (True, '{"timestamp": "soon"}'), (False, None),
    ]
    assert str(rows[0]["timestamp"]) == "2024-01-01 00:00:00"


def test_a_folder_without_files(spark, reader):
    path = scratch(spark, "lines")
    spark.createDataFrame([], "line string").write.text(path)
    assert reader().load(path).count() == 0


def test_stream_takes_each_file_once(spark, reader, entries):
    path, out, progress = (scratch(spark, n) for n in ("lines", "out", "progress"))
    stream = spark.readStream.format(tables.FORMAT).option("settleSeconds", 0).option("rangeBytes", 20_000).schema("task_id string, level string").load(path)

    def run():
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for part in range(3):
        sinks.export_logs(entries.where(F.col("task_id") % 3 == part), path)
        run()
        assert spark.read.parquet(out).count() == 1000 * (part + 1)
    run()
    assert texts(spark.read.parquet(out)) == texts(entries.select("task_id", "level"))
