from pyspark.sql import functions as F

from kinlight.sources import files
from kinlight.streaming import incremental


def test_rows_are_processed_once(spark, tmp_path):
    source, target, markers = (str(tmp_path / n) for n in ("in", "out", "marks"))
    fields = spark.createDataFrame([], "photo_id long, n int").schema

    def add(rows):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(source)

    def derive(batch):
        return batch.filter("n > 0").select("photo_id", F.explode(F.sequence(F.lit(1), "n")).alias("face"))

    def run():
        stream = incremental.new_rows(spark, source, fields)
        query = incremental.process_once(stream, ["photo_id"], derive, target, markers, str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()

    add([(1, 2), (2, 0)])
    run()
    add([(1, 2), (3, 1)])
    run()
    run()
    got = spark.read.parquet(target)
    assert sorted((r.photo_id, r.face) for r in got.collect()) == [(1, 1), (1, 2), (3, 1)]
    assert sorted(r.photo_id for r in spark.read.parquet(markers).collect()) == [1, 2, 3]


def test_new_files(spark, tmp_path):
    (tmp_path / "lib" / "sub").mkdir(parents=True)
    (tmp_path / "lib" / "a.JPG").write_bytes(b"1234")
    (tmp_path / "lib" / "sub" / "b.heic").write_bytes(b"12")
    (tmp_path / "lib" / "c.txt").write_bytes(b"1")
    (tmp_path / "lib" / ".hidden.jpg").write_bytes(b"1")
    found = files.list_files(spark, str(tmp_path / "lib"))
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in found.collect()) == [("a.JPG", 4), ("b.heic", 2)]
    assert [r.length for r in files.list_files(spark, str(tmp_path / "lib"), recursive=False).collect()] == [4]
    assert files.stat_file(spark, str(tmp_path / "lib" / "a.JPG")).count() == 1
    assert files.folder_bytes(spark, str(tmp_path / "lib")).first().bytes == 7
    query = incremental.new_files(spark, str(tmp_path / "lib")).select("path").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select * from seen").count() == 2


def test_decoding_and_codecs(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", bytearray(b"ok")), ("b.jpg", bytearray(b"bad")), ("c.heic", bytearray(b"ok")), ("d.txt", bytearray(b"ok"))], "path string, content binary")

    def decode(content, long_edge):
        if content != b"ok":
            raise ValueError
        return 2, 1, 2, "gray8", b"\x01\x02"

    got = {r.path: r.width for r in files.decode_images(rows, {"raster": decode}, 320).collect()}
    assert got == {"a.jpg": 2, "b.jpg": None, "c.heic": None, "d.txt": None}

    def tags(content):
        return {"width": 4, "height": 3, "orientation": 6, "make": "M", "model": "M1", "original": "2024:01:01 00:00:00"} if content == b"ok" else None

    meta = {r.path: r for r in files.read_metadata(rows, tags).collect()}
    assert (meta["a.jpg"].width, meta["a.jpg"].camera, meta["b.jpg"].width, meta["b.jpg"].orientation) == (3, "M1", None, 1)
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    back = v.select(files.decode_vector(files.encode_vector("v")).alias("v")).collect()
    assert [r.v for r in back] == [[1.5, -2.0], None]
    uuid = spark.createDataFrame([(bytearray(range(16)),)], "b binary").select(files.decode_uuid("b").alias("u")).first().u
    assert uuid == "00010203-0405-0607-0809-0a0b0c0d0e0f"


def test_signatures_of_changed_photos_are_stale(spark):
    p = spark.createDataFrame([(1, "2024-01-02", None), (2, "2024-01-01", None), (3, "2024-01-01", None), (4, "2024-01-01", "bad")], "photo_id long, m string, error string").withColumn("mtime_utc", F.col("m").cast("timestamp"))
    s = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01")], "photo_id long, c string").select("photo_id", F.col("c").cast("timestamp").alias("computed_utc"))
    assert sorted(r.photo_id for r in incremental.stale_signatures(p, s).collect()) == [1, 3]
    fresh = incremental.rederive(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(1, "c"), (1, "d")], "k long, v string"), ["k"])
    assert sorted(map(tuple, fresh.collect())) == [(1, "c"), (1, "d"), (2, "b")]
