import os

import pytest
from pyspark.sql import functions as F

from thicketry.sources import files
from thicketry.streaming import series


def image(path, w=2, h=2, v=128):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(f"P5 {w} {h} 255\n".encode() + bytes([v] * (w * h)))


def test_catalog_scan_and_masks(spark, tmp_path):
    root = str(tmp_path)
    for p in ("A/im/x.PNG", "B/im/x.png", "A/im/y.jpg", "A/im/note.txt"):
        image(f"{root}/{p}")
    cat = files.build_catalog(spark, [f"file://{root}"])
    assert [r.sample_key for r in cat.collect()] == ["A/x", "A/y", "B/x"]
    d = {r.mask_key for r in files.mask_dictionary(files.scan_images(spark, [f"file://{root}"])).collect()}
    assert d == {"A/x", "A/y", "B/x", "y", "im/x", "im/y"}
    image(f"{root}/A/im/x.jpg")
    with pytest.raises(ValueError, match="repeated keys"):
        files.build_catalog(spark, [f"file://{root}"])
    wide = b"P5\n# two bytes a cell\n2 1\n65535\n\xff\xff\x00\x80"
    got = files.read_gray(spark.createDataFrame([("w", wide)], "sample_key string, content binary")).first()
    assert (got.h, got.w) == (1, 2) and got.p == pytest.approx([1, 128 / 65535])
    for bad in (b"P6 1 1 255\n\x00", b"P5 2 2 255\n\x00", b"P5 2 2 70000\n\x00"):
        with pytest.raises(Exception, match="b: "):
            files.read_gray(spark.createDataFrame([("b", bad)], "sample_key string, content binary")).collect()
    gray = files.read_gray(files.scan_images(spark, [f"file://{root}"], content=True)).first()
    assert (gray.h, gray.w) == (2, 2) and gray.p[0] == pytest.approx(128 / 255)


def test_splits(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" A/x \r\n\nB/y\n")
    s = files.read_split(spark, str(tmp_path / "s.txt"))
    assert sorted(r.sample_key for r in s.collect()) == ["A/x", "B/y"]
    cat = spark.createDataFrame([("c",), ("a",), ("b",)], "sample_key string")
    mixed = spark.createDataFrame([("2",), ("a",)], "v string")
    assert sorted(r.sample_key for r in files.read_split_of_either(mixed, "v", cat).collect()) == ["a", "c"]
    print1 = files.write_split(cat, "sample_key", str(tmp_path / "o1"))
    print2 = files.write_split(cat.orderBy(F.desc("sample_key")).repartition(3), "sample_key", str(tmp_path / "o2"))
    assert print1 == print2 and spark.read.text(str(tmp_path / "o1")).count() == 3


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    p = str(tmp_path / "t")
    assert files.write_once(df, p) == "written" and files.write_once(df.orderBy(F.desc("k")), p) == "same"
    with pytest.raises(FileExistsError):
        files.write_once(df.limit(1), p)
    j = str(tmp_path / "m.json")
    assert files.write_json_once({"b": 1, "a": [1.5]}, j) == "written" and files.write_json_once({"a": [1.5], "b": 1}, j) == "same"
    with pytest.raises(FileExistsError):
        files.write_json_once({"a": 2}, j)


def test_audit_and_report(spark, tmp_path):
    files.write_audit(spark.createDataFrame([("b", 1.5), ("a", None)], "k string, v double"), "k", ["v"], str(tmp_path / "c"))
    rows = spark.read.option("header", "true").csv(str(tmp_path / "c")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("a", None), ("b", "1.5000000000")]
    assert "d1" in files.aligned_report([{"set": "d1", "mae": 0.5}], ["set", "mae"])


def batches(spark, tmp_path, parts, schema):
    src = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))


def finish(query):
    query.processAllAvailable()
    query.stop()


def test_alarm_stream(spark, tmp_path):
    s = batches(spark, tmp_path, [[("s", 0, 5.0), ("s", 1, 6.0)], [("s", 2, 7.0), ("s", 3, 1.0)]], "g string, t int, v double")
    finish(series.alarm_stream(s, "g", "t", "v", 4.0).writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    assert {r.t: r.alarm for r in spark.table("alarms").collect()} == {0: False, 1: False, 2: True, 3: False}


def test_average_stream(spark, tmp_path):
    s = batches(spark, tmp_path, [[("s", 0, 1.0), ("s", 1, 2.0)], [("s", 2, 3.0)]], "g string, t int, v double")
    finish(series.average_stream(s, "g", "t", "v", 0.5).writeStream.format("memory").queryName("averages").option("checkpointLocation", str(tmp_path / "c")).outputMode("update").start())
    assert max((r.n, r.ema) for r in spark.table("averages").collect()) == (3, 2.25)


def test_append_bank(spark, tmp_path):
    s = batches(spark, tmp_path, [[("a", 1)], [("b", 2)]], "k string, v int")
    bank = str(tmp_path / "bank")
    finish(series.append_bank(s, bank, str(tmp_path / "c"), "k").start())
    assert sorted(r.k for r in spark.read.parquet(bank).collect()) == ["a", "b"]
    spark.createDataFrame([("a", 9)], "k string, v int").coalesce(1).write.parquet(str(tmp_path / "in" / "b9"))
    q = series.append_bank(s, bank, str(tmp_path / "c"), "k").start()
    with pytest.raises(Exception, match="repeated keys"):
        q.processAllAvailable()
    q.stop()


def test_windowed_means_in_batch(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0)], "t string, g string, v double").withColumn("t", F.to_timestamp("t"))
    assert series.windowed_means(df, "t", "v", "g").first()["mean"] == 2.0


def test_half_written_batch_is_written_again(spark, tmp_path):
    """What a crash left in the folder for unfinished batches is not taken for a batch of the bank."""
    bank = tmp_path / "bank"
    (tmp_path / "bank.writing" / "dead").mkdir(parents=True)
    (tmp_path / "bank.writing" / "dead" / "part-0.parquet").write_bytes(b"half")
    s = batches(spark, tmp_path, [[("a", 1)]], "k string, v int")
    finish(series.append_bank(s, str(bank), str(tmp_path / "c"), "k").start())
    assert [r.k for r in spark.read.parquet(str(bank)).collect()] == ["a"]


def test_stored_tables_need_a_shared_folder(spark, monkeypatch):
    from thicketry import session

    class Elsewhere:
        def __init__(self, sc):
            self._jsc, self.master = self, "spark://there:7077"

        def sc(self):
            return self

        def conf(self):
            return self

        def get(self, *_):
            return ""

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    class Session:
        sparkContext = Elsewhere(None)
        conf = sparkContext

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())
    df = session.store(spark.range(5))
    assert df.count() == 5 and "tables-" + spark.sparkContext.applicationId in df.inputFiles()[0]


def test_load_split_names_all_that_is_wrong(spark, tmp_path):
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_key string")
    files.write_split(cat, "sample_key", str(tmp_path / "ok"))
    assert files.load_split(spark, str(tmp_path / "ok"), cat, 3).count() == 3
    (tmp_path / "bad.txt").write_text("c\na\nz\na\n")
    with pytest.raises(ValueError, match="1 repeated keys; 4 keys in place of 3; not in order; 1 unknown keys, the first z"):
        files.load_split(spark, str(tmp_path / "bad.txt"), cat, 3)


def test_images_out_and_prepared(spark, tmp_path):
    df = spark.createDataFrame([("A/x", 2, 2, [0.0, 1.0, 0.5, 2.0]), ("B/y", 1, 2, [float("nan"), 0.2])], "sample_key string, h int, w int, p array<double>")
    assert files.write_gray(df, str(tmp_path)) == 2
    back = files.scan_images(spark, [f"file://{tmp_path}"], ("pgm",), content=True)
    got = {r.sample_key: (r.h, r.w, r.p) for r in files.read_gray(back).collect()}
    assert got["A/x"] == (2, 2, pytest.approx([0, 1, 128 / 255, 1])) and got["B/y"] == (1, 2, pytest.approx([0, 0.2]))
    small = {r.sample_key: r.p for r in files.prepare_images(back, 1, 1, mean=0.5, deviation=0.25).collect()}
    assert small["A/x"] == pytest.approx([((1 + 1 + 128 / 255) / 4 - 0.5) / 0.25], abs=1e-5) and len(small["B/y"]) == 1
    with pytest.raises(Exception, match="unsafe"):
        files.write_gray(df.withColumn("sample_key", F.lit("../x")), str(tmp_path / "in"))


def test_replication_is_checked(spark):
    from thicketry.operators.relations import replicated

    assert replicated(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        replicated(spark.range(4), 3)
