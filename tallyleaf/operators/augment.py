"""Image preparation, variants, augmentation and drawing, with NumPy in tasks."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.operators import raster
from tallyleaf.operators.engines import image_of


def png(a: np.ndarray) -> bytes:
    """PNG bytes of a grey or BGR image."""
    rgb = a if a.ndim == 2 else a[..., ::-1]
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), np.ascontiguousarray(rgb).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def with_base64(images: DataFrame) -> DataFrame:
    """Adds image_base64, the PNG of each image as text."""

    @F.pandas_udf("string")
    def encode(h: pd.Series, w: pd.Series, n: pd.Series, data: pd.Series) -> pd.Series:
        rows = pd.DataFrame({"height": h, "width": w, "n_channels": n, "data": data})
        return pd.Series([base64.b64encode(png(image_of(r))).decode() for _, r in rows.iterrows()])

    return images.withColumn("image_base64", encode("height", "width", "n_channels", "data"))


def resize(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    y = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, a.shape[1] - 1)
    return sample(a, *np.meshgrid(y, x, indexing="ij"))


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = y - y0, x - x0
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    f = a.astype(np.float64)
    return raster.cut((1 - fy) * ((1 - fx) * f[y0, x0] + fx * f[y0, x1]) + fy * ((1 - fx) * f[y1, x0] + fx * f[y1, x1]))


def scale_for_ocr(height: Column, width: Column) -> Column:
    """The factor between a page and its prepared image: doubled under 1800 pixels, at most 2600."""
    side = F.greatest(height, width)
    doubled = F.when(side < 1800, 2.0).otherwise(1.0)
    return F.least(doubled, F.lit(2600.0) / side)


def prepare(a: np.ndarray) -> np.ndarray:
    g = raster.to_gray(a)
    side = max(g.shape)
    scale = min(2.0 if side < 1800 else 1.0, 2600 / side)
    g = raster.tiled(g if scale == 1 else resize(g, scale))
    return np.stack([g] * 3, axis=2)


def variants(images: DataFrame) -> DataFrame:
    """(doc_id, variant_no, variant, image columns): grey, enlarged if small, and three binarisations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                g = raster.to_gray(image_of(r))
                c = raster.tiled(g)
                made = [("gray", g), *([("upscaled", resize(g, 2.0))] if max(g.shape) < 1800 else []), ("clahe", c), ("clahe_otsu", raster.binary(c)), ("adaptive", raster.PROCESSORS["adaptive"](c))]
                rows += [(str(r["doc_id"]), k, n, *x.shape, 1, x.tobytes()) for k, (n, x) in enumerate(made)]
            yield pd.DataFrame(rows, columns=["doc_id", "variant_no", "variant", "height", "width", "n_channels", "data"])

    return images.mapInPandas(run, "doc_id string, variant_no int, variant string, height int, width int, n_channels int, data binary")


def crop(a: np.ndarray, box: tuple[int, int, int, int], padding: int = 6) -> np.ndarray:
    x1, y1, x2, y2 = box
    return a[max(0, y1 - padding) : min(a.shape[0], y2 + padding), max(0, x1 - padding) : min(a.shape[1], x2 + padding)]


def draw_boxes(a: np.ndarray, boxes: list[tuple[int, int, int, int]], colour=(0, 160, 0)) -> np.ndarray:
    out = np.stack([a] * 3, axis=2) if a.ndim == 2 else a.copy()
    h, w = out.shape[:2]
    for x1, y1, x2, y2 in boxes:
        x1, x2, y1, y2 = *np.clip((round(x1), round(x2)), 0, w - 1), *np.clip((round(y1), round(y2)), 0, h - 1)
        out[y1, x1 : x2 + 1] = out[y2, x1 : x2 + 1] = colour
        out[y1 : y2 + 1, x1] = out[y1 : y2 + 1, x2] = colour
    return out


def random_homography(width: int, height: int, rng: np.random.Generator) -> np.ndarray:
    """A slight change of view, turn and size; corners move inward only before the turn."""
    far = np.array([width, height]) * rng.uniform(0.015, 0.055, 2)
    src = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], dtype=np.float64)
    inward = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]])
    dst = src + inward * rng.uniform(0, 1, (4, 2)) * far
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    view = np.append(np.linalg.solve(np.array(rows), dst.ravel()), 1).reshape(3, 3)
    turn, size = np.deg2rad(rng.uniform(-2.5, 2.5)), rng.uniform(0.965, 1.035)
    c, s = size * np.cos(turn), size * np.sin(turn)
    cx, cy = width / 2, height / 2
    return np.array([[c, s, (1 - c) * cx - s * cy], [-s, c, s * cx + (1 - c) * cy], [0, 0, 1]]) @ view


def apply_matrix(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    z = np.concatenate([points, np.ones((len(points), 1))], axis=1) @ m.T
    return z[:, :2] / z[:, 2:]


def warp(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    h, w = a.shape[:2]
    y, x = np.mgrid[:h, :w]
    back = apply_matrix(np.linalg.inv(m), np.stack([x.ravel(), y.ravel()], axis=1).astype(np.float64))
    return sample(a, back[:, 1].reshape(h, w), back[:, 0].reshape(h, w))


def scan_effects(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Light, saturation, noise, blur and grey, each by its chance (no JPEG round trip)."""
    out = a.astype(np.float64) * rng.uniform(0.82, 1.22) + rng.uniform(-18, 22)
    if rng.random() < 0.55:
        grey = out.mean(axis=2, keepdims=True)
        out = (grey + (out - grey) * rng.uniform(0.55, 1.15)) * rng.uniform(0.88, 1.08)
    if rng.random() < 0.55:
        out = out + rng.normal(0, rng.uniform(2.0, 8.0), out.shape)
    out = raster.cut(out)
    if rng.random() < 0.45:
        k = raster.gaussian_kernel(int(rng.choice([3, 3, 5])))
        out = np.stack([raster.cut(raster.convolve(out[..., c], k)) for c in range(3)], axis=2)
    if rng.random() < 0.35:
        out = np.stack([raster.to_gray(out)] * 3, axis=2)
    return out


def augment(samples: DataFrame, seed: int = 20260615) -> DataFrame:
    """(sample, image columns, lines): images and their boxes warped alike.

    ``samples`` has sample, height, width, n_channels, data and boxes
    (array of struct cls, x1, y1, x2, y2); the draw depends on seed and sample.
    """
    from tallyleaf.operators import dataset

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                rng = np.random.default_rng([seed, int(r["sample"])])
                a = image_of(r)
                a = np.stack([a] * 3, axis=2) if a.ndim == 2 else a
                h, w = a.shape[:2]
                m = random_homography(w, h, rng)
                moved = []
                for b in r["boxes"] if r["boxes"] is not None else ():
                    p = apply_matrix(m, np.array([[b["x1"], b["y1"]], [b["x2"], b["y1"]], [b["x2"], b["y2"]], [b["x1"], b["y2"]]], dtype=np.float64))
                    moved.append({"cls": int(b["cls"]), "x1": p[:, 0].min(), "y1": p[:, 1].min(), "x2": p[:, 0].max(), "y2": p[:, 1].max()})
                rows.append((int(r["sample"]), h, w, 3, scan_effects(warp(a, m), rng).tobytes(), moved))
            yield pd.DataFrame(rows, columns=["sample", "height", "width", "n_channels", "data", "boxes"])

    out = samples.mapInPandas(run, "sample long, height int, width int, n_channels int, data binary, boxes array<struct<cls:int,x1:double,y1:double,x2:double,y2:double>>")
    line = lambda b: dataset.clipped_line(b["cls"], b["x1"], b["y1"], b["x2"], b["y2"], F.col("width").cast("double"), F.col("height").cast("double"))
    return out.withColumn("lines", F.filter(F.transform("boxes", line), lambda x: x.isNotNull())).drop("boxes")
