"""64-bit similarity signatures as two BIGINT halves, and hashes of names and grey images."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Fixed values of the FNV-1a hash of 32 bits.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Edge of the grid of the frequency hash, of its kept corner, and the longest edge for sharpness.
GRID, CORNER, SHARP_EDGE = 32, 8, 256


def halves(hex16: Column) -> Column:
    """Struct hi, lo of 16 lower-case hex digits; null if it is no such text."""
    ok = hex16.rlike("^[0-9a-f]{16}$")
    half = lambda at: F.conv(F.substring(hex16, at, 8), 16, 10).cast("long")
    return F.when(ok, F.struct(half(1).alias("hi"), half(9).alias("lo")))


def to_hex(hi: Column, lo: Column) -> Column:
    pad = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.concat(pad(hi), pad(lo))


def hamming(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    """Differing bits of two signatures."""
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def from_vector(v: Column) -> Column:
    """Signature of 64 numbers: bit i is set if number i is above the median of numbers 1 to 63; bit 0 never."""
    zero = F.lit(0).cast("long")

    def packed(middle: Column) -> Column:
        bits = F.transform(v, lambda x, i: F.when((i > 0) & (x > middle), 1).otherwise(0).cast("long"))
        half = lambda at: F.aggregate(F.slice(bits, at, 32), zero, lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
        return F.struct(half(1).alias("hi"), half(33).alias("lo"))

    # the median is bound once, not worked out again for every bit
    middle = F.array(F.element_at(F.sort_array(F.slice(v, 2, 63)), 32))
    return F.when(F.size(v) == 64, F.get(F.transform(middle, packed), F.lit(0)))


@pandas_udf(T.LongType())
def fnv1a32(s: pd.Series) -> pd.Series:
    """FNV-1a over UTF-16 code units; null gives null."""

    def one(x):
        if x is None:
            return None
        h = FNV_OFFSET
        for unit in np.frombuffer(x.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
            h = ((h ^ unit) * FNV_PRIME) & 0xFFFFFFFF
        return h

    return s.map(one).astype("Int64")


def fingerprint(content: Column, path: Column, size: Column, modified: Column) -> Column:
    """Identity of a file: its bytes' digest with path, size and time. Files alike in two folders differ."""
    return F.sha2(F.concat_ws("|", F.sha2(content, 256), path, size.cast("string"), modified.cast("string")), 256)


def luma(r, g, b) -> np.ndarray:
    """Rec. 601 luma of colour planes."""
    return 0.299 * np.asarray(r, float) + 0.587 * np.asarray(g, float) + 0.114 * np.asarray(b, float)


def shrink(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box means; nearest pixels where the target is larger. Here and below one image, or a stack of equal sides."""
    h, w = grey.shape[-2:]
    if height > h or width > w:
        return grey[..., np.minimum(h - 1, np.arange(height) * h // height), :][..., np.minimum(w - 1, np.arange(width) * w // width)].astype(float)
    rows, cols = np.arange(h) * height // h, np.arange(w) * width // w
    at_row, at_col = np.searchsorted(rows, np.arange(height)), np.searchsorted(cols, np.arange(width))
    total = np.add.reduceat(np.add.reduceat(grey.astype(float), at_row, axis=-2), at_col, axis=-1)
    return total / np.outer(np.bincount(rows, minlength=height), np.bincount(cols, minlength=width))


def _hex(bits: np.ndarray):
    """16 digits of 64 bits; a list of them for a stack."""
    if bits.ndim == 2:
        return np.packbits(bits.ravel()).tobytes().hex()
    return [x.tobytes().hex() for x in np.packbits(bits.reshape(len(bits), -1), axis=1)]


def _variance(x: np.ndarray):
    return x.var() if x.ndim == 2 else x.reshape(len(x), -1).var(axis=1)


def gradient_hash(grey: np.ndarray):
    """Signs of horizontal steps on a grid of 8 rows and 9 columns; set where it darkens to the right."""
    g = shrink(grey, 8, 9)
    return _hex(g[..., :-1] > g[..., 1:])


def ingest_hash(grey: np.ndarray):
    """Signs of horizontal steps of a grid of 8 rows and 9 columns sampled between pixels; set where it brightens to the right.

    A family of its own: neither its sampling nor its sense is gradient_hash()'s.
    """
    h, w = grey.shape[-2:]
    g = grey.astype(float)

    def sample(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) * size / n - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, size - 1), np.clip(low + 1, 0, size - 1), at - low

    y0, y1, ty = sample(8, h)
    x0, x1, tx = sample(9, w)
    at = lambda y, x: g[..., y[:, None], x[None, :]]
    upper = at(y0, x0) * (1 - tx) + at(y0, x1) * tx
    lower = at(y1, x0) * (1 - tx) + at(y1, x1) * tx
    small = upper * (1 - ty)[:, None] + lower * ty[:, None]
    return _hex(small[..., :-1] < small[..., 1:])


def raw_sharpness(grey: np.ndarray):
    """Variance of the Laplacian as it is, to two decimals; 0 of images under three pixels."""
    if min(grey.shape[-2:]) < 3:
        return 0.0 if grey.ndim == 2 else [0.0] * len(grey)
    g = grey.astype(float)
    lap = g[..., 1:-1, :-2] + g[..., 1:-1, 2:] + g[..., :-2, 1:-1] + g[..., 2:, 1:-1] - 4 * g[..., 1:-1, 1:-1]
    return (np.floor(_variance(lap) * 100 + 0.5) / 100).tolist()


def fitted(w: int, h: int, longest: int) -> tuple[int, int]:
    """Width and height brought down so that the longer side is at most so many pixels; never up."""
    scale = min(1.0, longest / max(w, h))
    return max(1, int(np.floor(w * scale + 0.5))), max(1, int(np.floor(h * scale + 0.5)))


def turned(grey: np.ndarray, quarter_turns: int, mirrored: bool) -> np.ndarray:
    """An image mirrored left to right, if it is to be, and then turned clockwise."""
    return np.rot90(grey[..., ::-1] if mirrored else grey, -quarter_turns, axes=(-2, -1))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    n = np.arange(GRID)
    return np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / (2 * GRID))


def frequency_hash(grey: np.ndarray):
    """Low frequencies of a cosine transform against their median; the constant part's bit stays 0."""
    low = (_cosines() @ shrink(grey, GRID, GRID) @ _cosines().T)[..., :CORNER, :CORNER]
    bits = low > np.median(low.reshape(*low.shape[:-2], -1)[..., 1:], axis=-1)[..., None, None]
    bits[..., 0, 0] = False
    return _hex(bits)


def sharpness(grey: np.ndarray):
    """Variance of the Laplacian against the image's own, at no more than SHARP_EDGE pixels an edge."""
    h, w = grey.shape[-2:]
    top = min(SHARP_EDGE, max(h, w))
    sh, sw = (max(1, int(np.floor(h / w * top + 0.5))), top) if w >= h else (top, max(1, int(np.floor(w / h * top + 0.5))))
    g = shrink(grey, sh, sw) if (sh, sw) != (h, w) else grey.astype(float)
    if min(sh, sw) < 3:
        return 0.0 if grey.ndim == 2 else [0.0] * len(grey)
    lap = 4 * g[..., 1:-1, 1:-1] - g[..., 1:-1, :-2] - g[..., 1:-1, 2:] - g[..., :-2, 1:-1] - g[..., 2:, 1:-1]
    return np.maximum(0.0, _variance(lap) / np.maximum(_variance(g), 1e-6)).tolist()


#: Numbers of pixels stacked at once.
STACK = 1 << 20


def _stacked(grey: pd.Series, w: pd.Series, h: pd.Series, more: list[tuple], work) -> list[tuple]:
    """work(images, *more) of each image, images of equal sides (and equal ``more``) as one stack; it gives a list of results and may fail.

    A stack that fails is done image by image, so one bad row ends nothing: its result is the error.
    """
    out: list = [None] * len(grey)
    alike: dict[tuple, list[int]] = {}
    for i, (pixels, width, height, m) in enumerate(zip(grey, w, h, more)):
        alike.setdefault((width, height, None if pixels is None else len(pixels), m), []).append(i)
    for (width, height, n, m), own in alike.items():
        step = max(1, STACK // max(1, n or 1))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            try:
                found = work(np.stack([np.asarray(grey.iloc[i], float) for i in some]).reshape(len(some), int(height), int(width)), *m)
            except Exception:  # one bad row must not end the job
                found = []
                for i in some:
                    try:
                        found.append(work(np.asarray(grey.iloc[i], float).reshape(int(height), int(width))[None], *m)[0])
                    except Exception as e:
                        found.append(e)
            for i, f in zip(some, found):
                out[i] = f
    return out


#: Longest edges of the images derived from each.
PREVIEW, THUMB = 1600, 320


@pandas_udf(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("preview_w", T.IntegerType()), T.StructField("preview_h", T.IntegerType()), T.StructField("thumb_w", T.IntegerType()), T.StructField("thumb_h", T.IntegerType()), T.StructField("thumb", T.BinaryType()), T.StructField("hash", T.StringType()), T.StructField("sharp", T.DoubleType()), T.StructField("err", T.StringType())]))
def derivatives(grey: pd.Series, w: pd.Series, h: pd.Series, turns: pd.Series, mirrored: pd.Series) -> pd.DataFrame:
    """From decoded grey images in one pass: upright sides, sides of the preview, the thumbnail's grey bytes, its hash of ingest and sharpness; failures go to err."""

    def work(stack: np.ndarray, r, f) -> list[tuple]:
        g = turned(stack, int(r), bool(f))
        uh, uw = g.shape[-2:]
        (pw, ph), (tw, th) = fitted(uw, uh, PREVIEW), fitted(uw, uh, THUMB)
        small = shrink(g, th, tw) if (tw, th) != (uw, uh) else g
        thumb = np.clip(np.floor(small + 0.5), 0, 255).astype(np.uint8)
        return [(uw, uh, pw, ph, tw, th, t.tobytes(), x, s, None) for t, x, s in zip(thumb, ingest_hash(small), raw_sharpness(small))]

    found = _stacked(grey, w, h, list(zip(turns, mirrored)), work)
    return pd.DataFrame([(*[None] * 9, str(x)[:200]) if isinstance(x, Exception) else x for x in found], columns=["w", "h", "preview_w", "preview_h", "thumb_w", "thumb_h", "thumb", "hash", "sharp", "err"])


@pandas_udf(T.StructType([T.StructField("dhash", T.StringType()), T.StructField("phash", T.StringType()), T.StructField("sharp", T.DoubleType()), T.StructField("err", T.StringType())]))
def image_features(grey: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    """Hashes and sharpness of decoded grey images (array of numbers, row by row); failures go to err.

    A decoder for compressed images is left to the caller: none is at hand here.
    """
    work = lambda g: [(*x, None) for x in zip(gradient_hash(g), frequency_hash(g), sharpness(g))]
    found = _stacked(grey, w, h, [()] * len(grey), work)
    return pd.DataFrame([(None, None, None, str(x)[:200]) if isinstance(x, Exception) else x for x in found], columns=["dhash", "phash", "sharp", "err"])
