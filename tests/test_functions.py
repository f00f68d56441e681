import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlight.functions import geometry as G
from kinlight.functions import hashing as H
from kinlight.functions import imaging as I
from kinlight.functions import text as T
from kinlight.functions import vectors as V


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def box(x, y, w, h):
    return G.box(*(F.lit(float(v)) for v in (x, y, w, h)))


def test_iou(spark):
    same, touch, half = one(spark, G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)), G.iou(box(0, 0, 10, 10), box(10, 0, 10, 10)), G.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)))
    assert (same, touch) == (1.0, 0.0) and half == pytest.approx(1 / 3)


def test_box_numbers(spark):
    even, odd, crop, none = one(spark, G.face_px(box(0, 0, 2.5, 9)), G.face_px(box(0, 0, 3.5, 9)), G.crop_region(box(1.2, 1.7, 3, 3), F.lit(2.0), F.lit(2.0), F.lit(8), F.lit(8)), G.crop_region(box(9, 9, 1, 1), F.lit(1.0), F.lit(1.0), F.lit(8), F.lit(8)))
    assert (even, odd) == (2, 4) and none is None
    assert (crop.x, crop.y, crop.w, crop.h) == (2, 3, 6, 5)


def test_letterbox(spark):
    f = one(spark, G.letterbox(F.lit(1280), F.lit(720), 640))[0]
    assert (f.scale, f.pad_x, f.pad_y) == (0.5, 0, 280)
    fit = I.Fit.of(1280, 720, 640)
    assert (fit.scale, fit.pad_x, fit.pad_y) == (0.5, 0, 280)


def test_quality_gate(spark):
    null = F.lit(None).cast("double")
    rows = one(spark, G.acceptable(F.lit(0.9), F.lit(50.0), F.lit(60.0), null), G.rejection(F.lit(0.5), F.lit(10.0), F.lit(10.0), null), G.rejection(F.lit(0.9), F.lit(10.0), F.lit(60.0), null), G.rejection(F.lit(0.9), F.lit(50.0), F.lit(60.0), null))
    assert rows[0] and rows[1].startswith("score") and rows[2].startswith("side") and rows[3] is None


@pytest.mark.parametrize("names", [["1", "2", "3", "10", "11", "16"], ["6", "007", "8"], ["img2a", "img2b", "img12b"], ["9" * 23, "1" + "0" * 23], ["7", "07", "007"], ["a", "B", "c"]])
def test_natural_order(spark, names):
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n string")
    assert [r.n for r in df.orderBy(*T.natural_key("n")).collect()] == names


def test_names_and_paths(spark):
    got = one(
        spark,
        T.folder_name(F.lit(" Sam. ")),
        T.folder_name(F.lit("a/b:c")),
        T.folder_name(F.lit("con")),
        T.folder_name(F.lit("...")),
        T.folder_name(F.lit("x" * 200)),
        T.valid_name(F.lit("  Al ")),
        T.valid_name(F.lit("  ")),
        T.canonical(F.lit("/a/./b//../c/")),
        T.inside(F.lit("/Lib/x"), F.lit("/lib/")),
        T.inside(F.lit("/library"), F.lit("/lib")),
        T.extension(F.lit("/a/b.JPG")),
        T.contains_text(F.lit("/a/IMG_01.jpg"), "img_0"),
        T.contains_text(F.lit("/a/IMGX01.jpg"), "IMG_01"),
        T.decoder_of(F.lit("x.HEIC")),
    )
    assert list(got) == ["Sam", "a_b_c", "_con", "Unnamed", "x" * 120, "Al", None, "/a/c", True, False, ".jpg", True, False, "heif"]


def test_captions(spark):
    got = one(spark, T.byte_size(F.lit(1023)), T.byte_size(F.lit(3 << 20)), T.byte_size_short(F.lit(1536)), T.byte_size_tile(F.lit(5)), T.percentage(F.lit(0.5)), T.initial(F.lit("éa")), T.progress(F.lit(3), F.lit(2)), T.progress(F.lit(3), F.lit(0)), T.counted(F.lit(1), "photo", "photos"), T.shard_path("r", F.lit("abcd")))
    assert list(got) == ["1,023 B", "3.0 MB", "2 KB", "5 B", "50%", "É", 1.0, None, "1 photo", "r/ab/abcd.jpg"]


def test_tags(spark):
    got = one(spark, T.camera(F.lit("Canon"), F.lit("Canon EOS")), T.camera(F.lit("Nikon"), F.lit("D5")), T.camera(F.lit("Nikon"), F.lit(" ")), T.taken_time(F.lit("bad"), F.lit("2024:02:03 04:05:06")).cast("string"), G.upright_size(F.lit(4), F.lit(3), F.lit(6))["width"])
    assert list(got) == ["Canon EOS", "Nikon D5", "Nikon", "2024-02-03 04:05:06", 3]


def test_hashes(spark):
    rng = np.random.default_rng(1)
    grid = rng.random(64)
    df = spark.createDataFrame([(grid.tolist(),)], "g array<double>")
    r = df.select(H.brightness_hash("g").alias("b"), H.ring_gradient_hash("g").alias("r")).first()
    assert r.b == I._bits(grid > grid.mean()) and r.r == I._bits(grid > np.roll(grid, -1))
    low = one(spark, H.hamming(F.lit((1 << 12) - 1), F.lit(0), F.lit(0), F.lit(0)), H.hamming(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")), H.hash_hex(F.lit(255), F.lit(-1).cast("long")))
    assert list(low) == [12, 128, "00000000000000FF" + "F" * 16]


def test_time_window(spark):
    t = "timestamp'2024-01-01 00:00:{}'"
    got = one(spark, *[H.within(F.expr(t.format("00")), F.expr(b), s) for b, s in ((t.format("30"), 30), (t.format("31"), 30), ("cast(null as timestamp)", 30), (t.format("59"), None))])
    assert list(got) == [True, False, True, True]


def test_vectors(spark):
    got = one(spark, V.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0))), V.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))), V.l2_normalise(F.array(F.lit(0.0), F.lit(0.0))))
    assert got[0] == 11 and got[1] == [0.6, 0.8] and got[2] == [0, 0]


def test_picture_signature():
    ramp = np.tile(np.arange(90, dtype=float), (80, 1))
    gradient, bright = I.perceptual_hash(ramp)
    assert gradient == 0 and bin(bright & (2**64 - 1)).count("1") == 32
    assert I.perceptual_hash(ramp[:, ::-1])[0] == -1
    board = np.kron(np.indices((48, 48)).sum(0) % 2, np.ones((4, 4))) * 255.0
    assert I.sharpness(board) > 1000 > I.sharpness(ramp)
    assert I.sharpness(np.full((50, 50), 7.0)) == 0


def test_signatures_on_columns(spark):
    image = np.arange(60 * 50 * 3, dtype=np.uint8).reshape(50, 60, 3)
    df = spark.createDataFrame([(1, 60, 50, 180, "bgr24", image.tobytes()), (2, None, None, None, None, None)], "photo_id long, width int, height int, stride int, format string, pixels binary")
    rows = {r.photo_id: r for r in I.signatures(df).collect()}
    luma = I.brightness(image)
    assert (rows[1].gradient, rows[1].brightness) == I.perceptual_hash(luma) and rows[1].sharpness == pytest.approx(I.sharpness(luma))
    assert rows[2].gradient is None


def test_halves_of_sizes_are_rounded_to_even(spark):
    sizes = [512, 1536, 2560, 3584, (1 << 20) * 5 // 4, (1 << 20) * 7 // 4, (1 << 20) * 5 // 2, (1 << 30) * 5 // 4, 1_101_004, None]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select(T.byte_size_tile("n").alias("tile"), T.byte_size_short("n").alias("short"))
    rows = df.collect()
    assert [r.tile for r in rows] == ["512 B", "2 KB", "2 KB", "4 KB", "1.2 MB", "1.8 MB", "2.5 MB", "1280.0 MB", "1.0 MB", None]
    assert [r.short for r in rows] == ["512 bytes", "2 KB", "2 KB", "4 KB", "1 MB", "2 MB", "2 MB", "1.2 GB", "1 MB", None]
    assert list(one(spark, T.percentage(F.lit(0.125)), T.percentage(F.lit(0.375)), T.percentage(F.lit(0.005)))) == ["12%", "38%", "0%"]


def test_orientation():
    a = np.arange(6).reshape(2, 3)
    assert I.upright(a, 6).tolist() == np.rot90(a, -1).tolist() and I.upright(a, 8).tolist() == np.rot90(a, 1).tolist()
    assert I.upright(a, 5).tolist() == a.T.tolist() and I.upright(a, 7).tolist() == np.rot90(a.T, 2).tolist()
    assert I.upright(a, 99).tolist() == a.tolist()


def test_suppression(spark):
    boxes = np.array([[0, 0, 10, 10, 0.90], [1, 1, 10, 10, 0.95], [2, 0, 10, 10, 0.85], [50, 50, 5, 5, 0.5]])
    assert I.suppress(boxes, 0.3) == [1, 3]
    df = spark.createDataFrame([(7, i, *map(float, b)) for i, b in enumerate(boxes)], "photo_id long, box_id long, x double, y double, w double, h double, score double")
    assert sorted((r.box_id, r.rank) for r in I.non_maximum_suppression(df, "photo_id", 0.3).collect()) == [(1, 1), (3, 2)]


def test_suppression_of_many_images_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    image = np.sort(rng.integers(0, 300, 4000))
    image[1000:2500] = 77
    image.sort()
    boxes = np.column_stack([rng.integers(0, 60, (4000, 2)), np.full((4000, 2), 20), rng.integers(0, 9, 4000) / 8]).astype(float)
    wanted = {}
    for i in np.unique(image):
        at = np.flatnonzero(image == i)
        wanted |= {(None if i == 5 else int(i), int(at[k])): n for n, k in enumerate(I.suppress(boxes[at], 0.3), 1)}
    rows = [(None if i == 5 else int(i), n, *map(float, b)) for n, (i, b) in enumerate(zip(image, boxes, strict=True))]
    df = spark.createDataFrame(rows, "photo_id long, box_id long, x double, y double, w double, h double, score double")
    calls = spark.sparkContext.accumulator(0)
    overlap = I.overlap

    def counted(one, many):
        calls.add(1)
        return overlap(one, many)

    monkeypatch.setattr(I, "overlap", counted)
    kernel = I.suppress_all(image, boxes, 0.3)
    assert {(None if image[k] == 5 else int(image[k]), int(k)): int(r) for k, r in zip(*kernel, strict=True)} == wanted
    assert calls.value == kernel[1].max()  # rounds, not images
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = {(r.photo_id, r.box_id): r.rank for r in I.non_maximum_suppression(df, "photo_id", 0.3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == wanted


@pytest.mark.parametrize(("stride", "n"), [(8, 12800), (16, 3200), (32, 800)])
def test_anchors(stride, n):
    a = I.anchor_centres(640, stride, 2)
    assert len(a) == n and a[0].tolist() == a[1].tolist() == [0, 0] and a[2].tolist() == [stride, 0]


def test_heads():
    n = 80 * 80
    cls, obj, box, kps = np.zeros(n), np.ones(n), np.zeros((n, 4)), np.zeros((n, 10))
    cls[81] = 0.81
    boxes, marks = I.decode_centre_head({8: (cls, obj, box, kps)})
    assert boxes.tolist() == [[4.0, 4.0, 8.0, 8.0, 0.9]] and marks[0].tolist() == [8.0] * 10
    score, dist, off = np.zeros(2 * n), np.ones((2 * n, 4)), np.zeros((2 * n, 10))
    score[5] = 0.7
    boxes, marks = I.decode_distance_head({8: (score, dist, off)})
    assert boxes.tolist() == [[8.0, -8.0, 16.0, 16.0, 0.7]] and marks[0].tolist() == [16.0, 0.0] * 5


def test_similarity_fit(spark):
    src = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)
    turn = np.array([[0, -3], [3, 0]])
    m = I.fit_similarity(src, src @ turn.T + [5, 7])
    assert np.allclose(m, [[0, -3, 5], [3, 0, 7]])
    assert I.fit_similarity(np.ones((3, 2)), src[:3]).tolist() == [[1, 0, 0], [0, 1, 0]]
    with pytest.raises(ValueError):
        I.fit_similarity(src[:1], src[:1])
    df = spark.createDataFrame([(1, *map(float, p), *map(float, q)) for p, q in zip(src, src @ turn.T + [5, 7])] + [(2, 1.0, 1.0, *map(float, p)) for p in src], "k long, x double, y double, u double, v double")
    rows = {r.k: r for r in I.similarity_sums(df, "k").collect()}
    assert [round(rows[1][c], 9) for c in ("m11", "m12", "m21", "dx", "dy")] == [0, -3, 3, 5, 7] and rows[2].m11 == 1
    image = np.zeros((200, 200, 3))
    assert I.align(image, np.array(G.ALIGNED_112).ravel()).shape == (112, 112, 3)


def test_detector_round_trip():
    image = np.zeros((360, 640, 3), np.uint8)

    def model(tensor):
        assert tensor.shape == (1, 3, 640, 640)
        n = 80 * 80
        cls, box = np.zeros(n), np.zeros((n, 4))
        cls[80 * 10 + 10] = 1
        box[:, 2:] = math.log(4)
        return {8: (cls, np.ones(n), box, np.zeros((n, 10)))}

    boxes, marks = I.make_detector("centre", model)(image)
    assert boxes.tolist() == [[64.0, 64.0, 32.0, 32.0, 1.0]] and marks.shape == (1, 10)
