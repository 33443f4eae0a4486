"""File inventories, images, exports, user functions and the registry."""

import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.registry import Registry, chain
from millrace.functions.udfs import record_function, scan_function
from millrace.operators import documents
from millrace.session import scratch
from millrace.sources import files, sinks


def test_inventory(spark, tmp_path):
    for name in ("a.PDF", "sub/b.md", ".git/c.md", "sub/node_modules/d.md", "e.bin", "notes_draft.bin", "noext"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("12345")
    root = f"file://{tmp_path}"
    rows = {r["relative_path"]: r for r in files.inventory(spark, root).collect()}
    assert set(rows) == {"a.PDF", "sub/b.md"}
    assert (rows["a.PDF"]["extension"], rows["a.PDF"]["size"], rows["a.PDF"]["name"]) == (".pdf", 5, "a.PDF")
    assert {r["name"] for r in files.inventory(spark, root, types=["DRAFT"]).collect()} == {"notes_draft.bin"}
    # Spark itself passes over names that start with a dot or an underscore.
    assert files.inventory(spark, root, types=[], excluded=[]).count() == 6


def test_content_table(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"hello")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "y.txt").write_bytes(b"no")
    row = files.contents(spark, str(tmp_path), "*.txt").collect()
    assert [(r["name"], r["size"], bytes(r["content"])) for r in row] == [("x.txt", 5, b"hello")]


def png(width, height):
    body = struct.pack(">II5B", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def test_image_sizes(spark):
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 40, -30) + bytes(28)
    jpeg = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 33, 44) + bytes(4)
    rows = [
        (1, "png", png(640, 480)), (2, "gif", b"GIF89a" + struct.pack("<HH", 20, 10)), (3, "bmp", bmp),
        (4, "bmp", b"BM"), (5, "png", b"junk"), (6, "tiff", b"II*\0"), (7, "jpg", jpeg), (8, "jpg", b"junk"),
    ]
    images = spark.createDataFrame(rows, "id bigint, kind string, content binary")
    size = documents.header_size(F.col("content"), F.col("kind"))
    found = images.where("kind <> 'jpg'").select("id", size.alias("s")).select("id", "s.*")
    sizes = found.unionByName(documents.jpeg_sizes(images.where("kind = 'jpg'"), "id"))
    lines = images.join(sizes, "id").select(
        "id",
        documents.image_text(F.col("kind"), F.col("width"), F.col("height"), F.octet_length("content")).alias("line"),
    )
    assert {r["id"]: r["line"] for r in lines.collect()} == {
        1: "[PNG image 640x480 - 33 bytes]",
        2: "[GIF image 20x10 - 10 bytes]",
        3: "[BMP image 40x-30 - 54 bytes]",
        4: "[BMP image - insufficient data]",
        5: "[PNG image - 4 bytes]",
        6: "[TIFF image - 4 bytes]",
        7: f"[JPEG image 44x33 - {len(jpeg)} bytes]",
        8: "[JPEG image - 4 bytes]",
    }


def test_sniffing_old_office_files(spark):
    df = spark.createDataFrame([("word", b"\xd0\xcf\x11\xe0rest"), ("excel", b"plain")], "kind string, content binary")
    rows = df.select(documents.sniff(F.col("content"), F.col("kind")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in rows] == [("[Word document (legacy) - 8 bytes]", True), ("plain", False)]


def test_chunks_cover_the_content(spark):
    df = spark.createDataFrame([(1, b"abcdefg"), (2, b""), (3, b"xyz")], "id bigint, content binary")
    rows = documents.chunks(df, "id", "content", 3).orderBy("id", "chunk_no").collect()
    assert [(r["id"], r["chunk_no"], bytes(r["chunk"])) for r in rows] == [
        (1, 0, b"abc"), (1, 1, b"def"), (1, 2, b"g"), (3, 0, b"xyz"),
    ]


def test_log_export(spark):
    logs = spark.sql(
        """SELECT timestamp_ntz'2024-01-01' AS timestamp, 'INFO' AS level, 's' AS service, 't' AS task_id, 'p' AS pipeline_id,
                  'n' AS node_id, 'say "hi", twice' AS message, cast(null AS string) AS context"""
    )
    with pytest.raises(ValueError):
        sinks.log_lines(logs, "unknown")
    path = scratch(spark, "export")
    sinks.export_logs(logs, path, "csv")
    back = spark.read.option("header", "true").option("escape", '"').csv(path).collect()[0]
    assert back["message"] == 'say "hi", twice' and back["node_id"] == "n"


def test_registry():
    mine = Registry()

    @mine.register("double", "latest", "normal")
    def double(df):
        return df

    assert mine.get("double") is double and mine.get("double", "latest") is double
    assert mine.names() == ["double:latest"] and mine.count_by_kind() == {"normal": 1}
    with pytest.raises(ValueError):
        mine.register("double", "latest")(double)
    with pytest.raises(ValueError):
        mine.register("x", kind="side")
    with pytest.raises(KeyError):
        mine.get("double", "v2")


def test_chain_stops_at_the_first_failure(spark):
    seen = []

    def broken(df):
        seen.append("broken")
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        chain(spark.range(1), ["identity", broken, lambda df: seen.append("after")])
    assert seen == ["broken"]


def test_setup_and_teardown_once_per_task(spark, tmp_path):
    log = str(tmp_path / "log")

    def setup():
        return {"log": log, "seen": 0}

    def teardown(state):
        with open(state["log"], "a") as f:
            f.write(f"{state['seen']}\n")

    def execute(batch, state):
        state["seen"] += len(batch)
        return pd.DataFrame({"id": batch["id"] + 1})

    out = record_function(spark.range(0, 100, 1, 4), execute, "id bigint", setup, teardown)
    assert out.agg(F.sum("id")).collect()[0][0] == sum(range(1, 101))
    with open(log) as f:
        assert sorted(int(line) for line in f) == [25, 25, 25, 25]


def test_table_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    for _ in range(2):
        sinks.write_table(df, "sink_table", path=str(tmp_path / "sink_table"))
    assert spark.table("sink_table").count() == 4
    spark.sql("DROP TABLE sink_table")


def test_batch_size_bounds_the_records_of_a_file(spark, tmp_path):
    path = str(tmp_path / "sized")
    sinks.write(spark.range(0, 25, 1, 1), path, batch_size=10)
    files_written = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    assert sorted(r["count"] for r in files_written.collect()) == [5, 10, 10]


def test_known_families_bring_their_help(spark):
    from millrace.operators import metrics

    row = spark.range(1).select(
        metrics.metric_help(F.lit("pipeline_count"), "x").alias("known"), metrics.metric_help(F.lit("mine"), "x").alias("other")
    ).collect()[0]
    assert tuple(row) == ("Total number of pipelines", "x")


def test_validators_from_settings(spark):
    from millrace.operators.validators import create_and_register, from_settings, validators

    df = spark.createDataFrame([("a", 1.0), ("", None)], "name string, score double")
    create_and_register("names", {"type": "schema", "rules": {"name": {"required": True, "min_length": 1}}})
    assert [r["valid"] for r in df.transform(validators.get("names")).collect()] == [True, False]
    summed = df.transform(from_settings({"type": "checksum", "column": "name"})).collect()
    assert summed[0]["checksum"] == "0cc175b9c0f1b6a831c399e269772661"
    assert from_settings({"type": "checksum", "column": "name", "algorithm": "SHA-256"})(df).collect()[0]["input_size"] == 1
    verdict = from_settings({"type": "quality", "quality_rules": {"min_completeness": 0.7, "min_accuracy": 0.5}})(df).collect()[0]
    assert (verdict["completeness"], verdict["accuracy"], verdict["valid"]) == (0.75, 0.5, True)
    for settings in ({"type": "schema"}, {"type": "checksum", "column": "name", "algorithm": "crc"}, {"type": "other"}):
        with pytest.raises(ValueError):
            from_settings(settings)


def test_label_values_are_escaped(spark):
    from millrace.operators import metrics

    rows = spark.createDataFrame([("m", 'a"b\\c\nd', None, 1.5)], "metric string, x string, y string, value double")
    lines = [r["line"] for r in metrics.exposition(["x", "y"], "Own", counters=rows, gauges=rows.limit(0)).collect()]
    assert lines == ["# HELP m Own", "# TYPE m counter", 'm{x="a\\"b\\\\c\\nd",y=""} 1.500000']


def test_scans_of_more_rows_than_a_piece(spark):
    found = scan_function(spark.range(3).withColumn("v", F.col("id")), "id", "v", lambda v: ((i,) for i in range(v * 15_000)), "n int")
    assert {(r["id"], r["c"], r["top"]) for r in found.groupBy("id").agg(F.count("*").alias("c"), F.max("n").alias("top")).collect()} == {
        (1, 15_000, 14_999), (2, 30_000, 29_999)
    }
