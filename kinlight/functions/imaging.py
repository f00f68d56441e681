"""Numpy kernels on pixel arrays and model outputs, and Arrow functions that run them on columns.

Images are arrays (height, width) or (height, width, 3) of bytes. Nothing here loads a model: detector heads
take the raw outputs, and model runs are injected by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.functions.geometry import ALIGNED_112

SHARPNESS_SIDE = 48
STRIDES = (8, 16, 32)
BYTES_PER_PIXEL = {"gray8": 1, "bgr24": 3, "rgb24": 3}
BOX = "struct<x:double,y:double,w:double,h:double,score:double>"


def to_array(pixels: bytes, width: int, height: int, stride: int, fmt: str) -> np.ndarray:
    """A view of a pixel buffer without its row padding."""
    depth = BYTES_PER_PIXEL[fmt]
    rows = np.frombuffer(pixels, np.uint8)[: stride * height].reshape(height, stride)[:, : width * depth]
    return rows.reshape(height, width) if depth == 1 else rows.reshape(height, width, 3)


def brightness(image: np.ndarray, fmt: str = "bgr24") -> np.ndarray:
    """Luma of each pixel; gray passes through."""
    if image.ndim == 2:
        return image.astype(float)
    weights = np.array([0.114, 0.587, 0.299]) if fmt == "bgr24" else np.array([0.299, 0.587, 0.114])
    return image.astype(float) @ weights


def reduce_to_grid(luma: np.ndarray, columns: int, rows: int) -> np.ndarray:
    """Means of a picture's cells (rows x columns) in single precision; cells without pixels are 0."""
    height, width = luma.shape
    cy = np.minimum(rows - 1, np.arange(height) * rows // height)
    cx = np.minimum(columns - 1, np.arange(width) * columns // width)
    at = (cy[:, None] * columns + cx[None, :]).ravel()
    total = np.bincount(at, luma.ravel(), rows * columns)
    n = np.bincount(at, minlength=rows * columns)
    return np.where(n > 0, total / np.maximum(n, 1), 0).astype(np.float32).reshape(rows, columns)


def _bits(flags: np.ndarray) -> int:
    return int(np.packbits(flags.ravel(), bitorder="little").view("<i8")[0])


def perceptual_hash(luma: np.ndarray) -> tuple[int, int]:
    """The gradient and the brightness word, as signed longs."""
    wide, square = reduce_to_grid(luma, 9, 8), reduce_to_grid(luma, 8, 8)
    return _bits(wide[:, :-1] > wide[:, 1:]), _bits(square > square.astype(float).mean())


def sharpness(luma: np.ndarray, side: int = SHARPNESS_SIDE) -> float:
    """The variance of the 4-neighbour Laplacian on the inner cells of a reduced picture."""
    g = reduce_to_grid(luma, side, side).astype(float)
    edges = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
    return max(0.0, float((edges * edges).mean() - edges.mean() ** 2))


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """Undo an orientation tag; values outside 2 to 8 leave the picture as it is."""
    turned = {
        2: lambda a: a[:, ::-1],
        3: lambda a: a[::-1, ::-1],
        4: lambda a: a[::-1],
        5: lambda a: a.swapaxes(0, 1),
        6: lambda a: a.swapaxes(0, 1)[:, ::-1],
        7: lambda a: a.swapaxes(0, 1)[::-1, ::-1],
        8: lambda a: a.swapaxes(0, 1)[::-1],
    }
    return np.ascontiguousarray(turned.get(orientation, lambda a: a)(image))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize with pixel centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    return _sample(image, *np.meshgrid(x, y))


def _sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples at points; outside, the border is repeated."""
    x, y = np.clip(x, 0, image.shape[1] - 1), np.clip(y, 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = x - x0, y - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    low = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return top * (1 - fy) + low * fy


@dataclass(frozen=True)
class Fit:
    """How a picture was fitted into a square: padding is at the right and the bottom only."""

    width: int
    height: int
    size: int
    scale: float
    pad_x: int
    pad_y: int

    @staticmethod
    def of(width: int, height: int, size: int) -> Fit:
        if width <= 0 or height <= 0:
            raise ValueError("a picture needs positive sides")
        scale = min(size / width, size / height)
        return Fit(width, height, size, scale, size - min(size, round(width * scale)), size - min(size, round(height * scale)))

    def back(self, boxes: np.ndarray) -> np.ndarray:
        """Boxes (x, y, w, h, score) in the picture's own pixels, clamped to it."""
        out = boxes.copy()
        corner = np.clip((boxes[:, :2] + boxes[:, 2:4]) / self.scale, 0, [self.width, self.height])
        out[:, :2] = np.clip(boxes[:, :2] / self.scale, 0, [self.width, self.height])
        out[:, 2:4] = np.maximum(0, corner - out[:, :2])
        return out

    def back_points(self, points: np.ndarray) -> np.ndarray:
        """Points in the picture's own pixels; they aren't clamped."""
        return points / self.scale


def to_tensor(image: np.ndarray, fit: Fit, mean: float, std: float, rgb: bool) -> np.ndarray:
    """A BGR picture as a (1, 3, size, size) tensor; what is padded is 0."""
    small = resize(image, fit.size - fit.pad_x, fit.size - fit.pad_y)
    channels = small[..., ::-1] if rgb else small
    out = np.zeros((1, 3, fit.size, fit.size), np.float32)
    out[0, :, : small.shape[0], : small.shape[1]] = (np.moveaxis(channels, -1, 0) - mean) / std
    return out


def anchor_centres(size: int, stride: int, per_cell: int) -> np.ndarray:
    """Anchor points (x, y), row by row, with the anchors of a cell next to each other."""
    cells = size // stride
    y, x = np.divmod(np.arange(cells * cells), cells)
    return np.repeat(np.column_stack([x, y]) * stride, per_cell, axis=0).astype(float)


def overlap(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """IoU of a box with each of ``many``, or of as many boxes row by row."""
    low = np.maximum(one[..., :2], many[:, :2])
    high = np.minimum(one[..., :2] + one[..., 2:4], many[:, :2] + many[:, 2:4])
    side = np.maximum(0, high - low)
    shared = side[:, 0] * side[:, 1]
    union = one[..., 2] * one[..., 3] + many[:, 2] * many[:, 3] - shared
    return np.where((union > 0) & (shared > 0), shared / np.where(union > 0, union, 1), 0)


def suppress(boxes: np.ndarray, threshold: float, most: int = 5000) -> list[int]:
    """Greedy non-maximum suppression on (x, y, w, h, score): kept indices by falling score, earlier first."""
    order = np.argsort(-boxes[:, 4], kind="stable")
    kept: list[int] = []
    while len(order) and len(kept) < most:
        best, order = int(order[0]), order[1:]
        kept.append(best)
        order = order[overlap(boxes[best], boxes[order]) <= threshold]
    return kept


def decode_centre_head(outputs: dict[int, tuple[np.ndarray, ...]], size: int = 640, least: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Boxes and ten landmark values of a head that gives class, objectness, centre and log-size offsets and
    landmark offsets per cell and stride."""
    boxes, marks = [], []
    for stride, (cls, obj, box, points) in outputs.items():
        cells = size // stride
        n = cells * cells
        cls, obj, box, points = cls.reshape(-1)[:n], obj.reshape(-1)[:n], box.reshape(-1, 4)[:n], points.reshape(-1, 10)[:n]
        score = np.sqrt(np.clip(cls, 0, 1) * np.clip(obj, 0, 1))
        keep = np.flatnonzero(score >= least)
        row, column = np.divmod(keep, cells)
        cell = np.column_stack([column, row])
        centre = (cell + box[keep, :2]) * stride
        side = np.exp(box[keep, 2:]) * stride
        boxes.append(np.column_stack([centre - side / 2, side, score[keep]]))
        marks.append((np.tile(cell, 5) + points[keep]) * stride)
    return np.concatenate([*boxes, np.zeros((0, 5))]), np.concatenate([*marks, np.zeros((0, 10))])


def decode_distance_head(outputs: dict[int, tuple[np.ndarray, ...]], size: int = 640, per_cell: int = 2, least: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Boxes and landmarks of a head that gives scores, distances to the four sides and landmark offsets, in
    units of the stride, per anchor."""
    boxes, marks = [], []
    for stride, (score, box, points) in outputs.items():
        centres = anchor_centres(size, stride, per_cell)
        n = min(len(centres), score.size)
        score, box, points = score.reshape(-1)[:n], box.reshape(-1, 4)[:n] * stride, points.reshape(-1, 10)[:n] * stride
        keep = np.flatnonzero(score >= least)
        at = centres[keep]
        boxes.append(np.column_stack([at - box[keep, :2], box[keep, :2] + box[keep, 2:], score[keep]]))
        marks.append(np.tile(at, 5) + points[keep])
    return np.concatenate([*boxes, np.zeros((0, 5))]), np.concatenate([*marks, np.zeros((0, 10))])


def fit_similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 matrix of rotation, scale and shift, without reflection, that takes points to points with
    least squares; points that all coincide give the identity."""
    if len(source) != len(target) or len(source) < 2:
        raise ValueError("two or more points on either side, equally many, are needed")
    a, b = source - source.mean(axis=0), target - target.mean(axis=0)
    energy = (a * a).sum()
    if energy <= np.finfo(float).tiny:
        return np.array([[1.0, 0, 0], [0, 1.0, 0]])
    cos, sin = (a * b).sum() / energy, (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / energy
    turn = np.array([[cos, -sin], [sin, cos]])
    return np.column_stack([turn, target.mean(axis=0) - turn @ source.mean(axis=0)])


def align(image: np.ndarray, landmarks: np.ndarray, size: int = 112, template: list[tuple[float, float]] | None = None) -> np.ndarray:
    """The crop in which five landmarks lie where the template has them; outside, the border is repeated."""
    matrix = fit_similarity(np.asarray(landmarks, float).reshape(5, 2), np.array(template or ALIGNED_112))
    back = np.linalg.inv(matrix[:, :2])
    x, y = np.meshgrid(np.arange(size), np.arange(size))
    at = np.stack([x - matrix[0, 2], y - matrix[1, 2]], axis=-1) @ back.T
    return _sample(image, at[..., 0], at[..., 1])


# --- on columns --------------------------------------------------------------------------------------------


def signatures(images: DataFrame) -> DataFrame:
    """(photo_id, gradient, brightness, sharpness) of ``images(photo_id, width, height, stride, format,
    pixels)``; null where there are no pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if r.pixels is None or not r.width or not r.height:
                    rows.append((r.photo_id, None, None, None))
                    continue
                luma = brightness(to_array(r.pixels, int(r.width), int(r.height), int(r.stride), r.format), r.format)
                rows.append((r.photo_id, *perceptual_hash(luma), sharpness(luma)))
            out = pd.DataFrame(rows, columns=["photo_id", "gradient", "brightness", "sharpness"])
            yield out.astype({"gradient": "Int64", "brightness": "Int64"})

    return images.select("photo_id", "width", "height", "stride", "format", "pixels").mapInPandas(run, "photo_id long, gradient long, brightness long, sharpness double")


def suppress_all(image: np.ndarray, boxes: np.ndarray, threshold: float, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """:func:`suppress` of many images at once: kept rows and their ranks in their image, for numbers of images in
    rising order. Each round keeps the best box that every image has left."""
    left = np.lexsort((-boxes[:, 4], image))
    kept: list[np.ndarray] = []
    while len(left) and len(kept) < most:
        first = np.diff(image[left], prepend=-1) != 0
        best = left[first]
        kept.append(best)
        rivals = best[np.cumsum(first) - 1]
        left = left[~first & (overlap(boxes[rivals], boxes[left]) <= threshold)]
    ranks = np.repeat(np.arange(1, len(kept) + 1, dtype=np.int32), [len(k) for k in kept])
    return np.concatenate([*kept, np.zeros(0, np.int64)]), ranks


def _image_numbers(key: pa.Array) -> np.ndarray:
    """Numbers from 0 of runs of equal keys; null is a key."""
    values, known = pc.fill_null(key, 0).to_numpy(zero_copy_only=False), pc.is_valid(key).to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[False, (values[1:] != values[:-1]) | (known[1:] != known[:-1])])


def non_maximum_suppression(boxes: DataFrame, key: str, threshold: float, id_col: str = "box_id") -> DataFrame:
    """Kept boxes of each image: rows of ``boxes(key, box_id, x, y, w, h, score)`` with ``rank`` by score. Boxes are
    sorted by image inside partitions, and a task works on the images of an Arrow batch at once. The boxes of one image
    are one task's; images are bounded by the detector's anchors."""

    def settle(rows: pa.Table) -> list[pa.RecordBatch]:
        values = np.column_stack([rows.column(c).to_numpy() for c in ("x", "y", "w", "h", "score")])
        kept, ranks = suppress_all(_image_numbers(rows.column(key).combine_chunks()), values, threshold)
        found = rows.select([key, id_col]).take(pa.array(kept)).append_column("rank", pa.array(ranks))
        return found.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0].as_py() == batch.column(0)[-1].as_py():
                continue  # one image so far
            rows = pa.Table.from_batches(held)
            image = _image_numbers(rows.column(key).combine_chunks())
            last = int(np.searchsorted(image, image[-1]))
            yield from settle(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    rows = boxes.select(F.col(key).cast("long").alias(key), F.col(id_col).cast("long").alias(id_col), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "score")])
    dealt = rows.repartition(key).sortWithinPartitions(key, F.col(id_col).asc_nulls_last())
    return dealt.mapInArrow(run, f"{key} long, {id_col} long, rank int")


def detect(images: DataFrame, detector: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Run a detector on each image and explode what it finds: (photo_id, n, x, y, w, h, score, landmarks).
    The detector is loaded by the function once a worker; images without faces give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if r.pixels is None:
                    continue
                boxes, marks = detector(to_array(r.pixels, int(r.width), int(r.height), int(r.stride), r.format))
                rows += [(r.photo_id, i, *map(float, b), [float(v) for v in m]) for i, (b, m) in enumerate(zip(boxes, marks, strict=True))]
            yield pd.DataFrame(rows, columns=["photo_id", "n", "x", "y", "w", "h", "score", "landmarks"])

    return images.select("photo_id", "width", "height", "stride", "format", "pixels").mapInPandas(run, "photo_id long, n int, x double, y double, w double, h double, score double, landmarks array<float>")


def embed(crops: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], dims: int, batch: int = 8) -> Column:
    """A column function that embeds crops by an injected model in batches and scales to unit length."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    def build():
        model = make_model()

        def predict(inputs: np.ndarray) -> np.ndarray:
            out = model(inputs)
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return np.where(length > 1e-12, out / np.maximum(length, 1e-12), out)

        return predict

    return predict_batch_udf(build, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[dims]])


#: Detectors by id: what decodes their heads, thresholds of score and overlap, and pre-processing.
DETECTORS = {
    "centre": {"decode": decode_centre_head, "score": 0.5, "overlap": 0.3, "mean": 0.0, "std": 1.0, "rgb": False},
    "distance": {"decode": decode_distance_head, "score": 0.5, "overlap": 0.4, "mean": 127.5, "std": 128.0, "rgb": True},
}
DEFAULT_DETECTOR = "centre"


def make_detector(name: str, run_model: Callable[[np.ndarray], dict[int, tuple[np.ndarray, ...]]], size: int = 640):
    """A detector for :func:`detect` from a model's runner: fit, pre-process, run, decode, suppress, map back."""
    spec = DETECTORS[name]

    def detector(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = Fit.of(image.shape[1], image.shape[0], size)
        boxes, marks = spec["decode"](run_model(to_tensor(image, fit, spec["mean"], spec["std"], spec["rgb"])), size, least=spec["score"])
        kept = suppress(boxes, spec["overlap"])
        return fit.back(boxes[kept]), fit.back_points(marks[kept])

    return detector


def session(path: str):
    """An inference session that uses a GPU where there is one and the CPU otherwise."""
    import onnxruntime

    wanted = ["CUDAExecutionProvider", "CPUExecutionProvider"]
    return onnxruntime.InferenceSession(path, providers=[p for p in wanted if p in onnxruntime.get_available_providers()])


def similarity_sums(points: DataFrame, key: str) -> DataFrame:
    """Least-squares similarity transforms of all keys at once from ``points(key, x, y, u, v)``, as sums: (key,
    m11, m12, m21, m22, dx, dy). Keys whose points coincide get the identity."""
    means = points.groupBy(key).agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"])
    d = points.join(means, key).select(key, *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyuv"], *[f"m{c}" for c in "xyuv"])
    s = d.groupBy(key).agg(F.sum(F.col("x") * F.col("u") + F.col("y") * F.col("v")).alias("dot"), F.sum(F.col("x") * F.col("v") - F.col("y") * F.col("u")).alias("cross"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("energy"), *[F.first(f"m{c}").alias(f"m{c}") for c in "xyuv"])
    flat = F.col("energy") <= 2.3e-308
    cos, sin = F.col("dot") / F.nullif("energy", F.lit(0.0)), F.col("cross") / F.nullif("energy", F.lit(0.0))
    dx = F.col("mu") - (cos * F.col("mx") - sin * F.col("my"))
    dy = F.col("mv") - (sin * F.col("mx") + cos * F.col("my"))
    values = {"m11": (cos, 1.0), "m12": (-sin, 0.0), "m21": (sin, 0.0), "m22": (cos, 1.0), "dx": (dx, 0.0), "dy": (dy, 0.0)}
    return s.select(key, *[F.when(flat, default).otherwise(value).alias(n) for n, (value, default) in values.items()])
