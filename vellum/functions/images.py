"""Raster functions over Spark's image rows (BGR bytes) by numpy, and their sizes as native expressions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PIXELS = 1536 * 28 * 28


def pixels(data: bytes, height: int, width: int, channels: int = 3) -> np.ndarray:
    """H x W x 3 BGR."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def gray(a: np.ndarray) -> np.ndarray:
    """IMG3, its weights in 32768ths; a page that is gray already stays."""
    if a.ndim == 2:
        return a
    b, g, r = (a[:, :, i].astype(np.int32) for i in range(3))
    return ((3735 * b + 19235 * g + 9798 * r + 16384) >> 15).astype(np.uint8)


def dark_ratio(a: np.ndarray, threshold: int = 210) -> float:
    """FIL2: percent of the pixels darker than the threshold."""
    return 100.0 * int((gray(a) < threshold).sum()) / (a.shape[0] * a.shape[1])


def _dilate(m: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        p = np.pad(m, 1)
        m = np.logical_or.reduce([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)])
    return m


def _runs(m: np.ndarray, corners: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each row, as starts and ends among the pixels of rows one longer, and the least run that each hangs together with, corners counting or not: runs that touch the ones below are links, and the least number spreads along links by leaps."""
    w = m.shape[1] + 1
    flat = np.pad(m, ((0, 0), (0, 1))).ravel().astype(np.int8)  # a gap behind each row
    edge = np.flatnonzero(np.diff(flat, prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    # Runs of the row below that begin before this one's end + 1 and end behind its start - 1 touch it by a corner.
    lo, hi = np.searchsorted(end, start + w, "left" if corners else "right"), np.searchsorted(start, end + w, "right" if corners else "left")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(start)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    label = np.arange(len(start))
    while len(a):
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((next_ := label[label]) != label).any():
            label = next_
    return start, end, label


def blobs(m: np.ndarray) -> list[int]:
    """Pixels of each 8-connected component."""
    start, end, label = _runs(m)
    return [int(n) for n in np.bincount(label, end - start) if n]


def _filled(m: np.ndarray) -> np.ndarray:
    """m with all that its blobs enclose: what the ground doesn't reach from the border by sides."""
    ground = np.pad(~m, 1, constant_values=True)
    start, end, label = _runs(ground, corners=False)
    outer = label == 0  # the first run is the border's
    edge = np.zeros(ground.shape[0] * (ground.shape[1] + 1) + 1, np.int8)
    edge[start[outer]] = 1
    edge[end[outer]] = -1
    outside = np.cumsum(edge[:-1], dtype=np.int8).reshape(ground.shape[0], -1)
    return outside[1:-1, 1:-2] == 0


def contour_areas(m: np.ndarray) -> list[float]:
    """The areas within the outermost contours of blobs, each a polygon through the middles of the blob's border pixels; blobs in the hole of another have none of their own.

    Four pixels in a square add the square between their middles, three add its half, and fewer add nothing.
    """
    m = _filled(m)
    start, _, label = _runs(m)
    if not len(start):
        return []
    p = m.astype(np.int8)
    n = p[:-1, :-1] + p[:-1, 1:] + p[1:, :-1] + p[1:, 1:]
    y, x = np.nonzero(n >= 3)
    of = label[np.searchsorted(start, y * (m.shape[1] + 1) + x + 1 - p[y, x], "right") - 1]  # the upper left pixel's run, or the upper right's where that is missing
    areas = np.bincount(of, np.where(n[y, x] == 4, 1.0, 0.5), len(start))
    return areas[np.unique(label)].tolist()


def ink(a: np.ndarray, threshold: int = 200, least: float = 10) -> tuple[float, int]:
    """FIL3's features: percent of ink, and word blobs whose outer contour holds an area above least."""
    return ink_percent(a, threshold), sum(area > least for area in contour_areas(_dilate(gray(a) <= threshold, 2)))


def ink_percent(a: np.ndarray, threshold: int = 200) -> float:
    """FIL3's first feature alone, which needs no blobs."""
    dark = gray(a) <= threshold
    return 100.0 * int(dark.sum()) / dark.size


def page_kind(dark: Column, words: Column, blank: float = 0.05, sparse: float = 0.8) -> Column:
    """FIL3's decision."""
    return F.when((dark <= blank) & (words < 3), "blank").when((dark <= sparse) | (words < 15), "sparse").otherwise("content")


def paper_colour(a: np.ndarray) -> int:
    """IMG1: mean gray of the two bottom corners."""
    h, w = a.shape[:2]
    m = max(1, min(40, h // 4, w // 4))
    g = gray(a)
    return int(round(float(np.concatenate([g[h - m :, :m].ravel(), g[h - m :, w - m :].ravel()]).mean())))


def whiteout(a: np.ndarray, percent: float = 10.0) -> np.ndarray:
    """IMG2: the top of a page in its paper colour, the last row inclusive."""
    last = int(a.shape[0] * percent / 100)
    if last <= 0:
        raise ValueError("nothing to white out")
    out = a.copy()
    out[: last + 1] = paper_colour(a)
    return out


def _any_near(m: np.ndarray, before: int, behind: int) -> np.ndarray:
    """Of each row's pixels: whether one from so many before to so many behind is set; beyond the border none is."""
    total = np.cumsum(np.pad(m.astype(np.int32), ((0, 0), (before + 1, behind))), axis=1)
    return total[:, before + behind + 1 :] - total[:, : -before - behind - 1] > 0


def _stripes(dark: np.ndarray, size: int = 50) -> np.ndarray:
    """The words of a line grown together: dilated twice and eroded once by a row of so many pixels, whose anchor is its pixel size // 2."""
    before, behind = size // 2, size - 1 - size // 2
    grown = _any_near(_any_near(dark, before, behind), before, behind)
    return ~_any_near(~grown, before, behind)


def canny(m: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Canny's edges of a gray picture: Sobel gradients 3 x 3, thinned along one of four directions, and followed from the strong to the weak ones; sizes of gradients are |dx| + |dy|."""
    p = np.pad(m.astype(np.int32), 1, mode="edge")
    rows, columns = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    dx, dy = rows[:, 2:] - rows[:, :-2], columns[2:] - columns[:-2]
    size = np.pad(np.abs(dx) + np.abs(dy), 1)
    y, x = np.nonzero(size[1:-1, 1:-1] > low)
    gx, gy = dx[y, x], dy[y, x]
    ax, ay = np.abs(gx).astype(np.int64), np.abs(gy).astype(np.int64) << 15
    flat, steep = ay < ax * 13573, ay > ax * 13573 + (ax << 16)  # 13573: the tangent of 22.5 degrees in 2 ** 15ths
    s = np.where((gx ^ gy) < 0, -1, 1)
    i, j = np.where(flat, 0, 1), np.where(flat, 1, np.where(steep, 0, s))  # the neighbour behind; the one before lies opposite
    here, before, behind = size[y + 1, x + 1], size[y + 1 - i, x + 1 - j], size[y + 1 + i, x + 1 + j]
    most = (here > before) & np.where(flat | steep, here >= behind, here > behind)
    y, x, here = y[most], x[most], here[most]
    thin = np.zeros(m.shape, bool)
    thin[y, x] = True
    start, _, label = _runs(thin)
    of = label[np.searchsorted(start, y * (m.shape[1] + 1) + x, "right") - 1]
    strong = np.zeros(len(start), bool)
    strong[of[here > high]] = True
    keep = strong[of]
    thin[y[~keep], x[~keep]] = False
    return thin


def _shuffled(n: int) -> list[int]:
    """The order in which the probabilistic transform takes n points: a multiply-with-carry generator from a fixed seed draws among those left, and the last one fills the gap."""
    left, out, state = list(range(n)), [], (1 << 64) - 1
    for count in range(n, 0, -1):
        state = (state & 0xFFFFFFFF) * 4164903690 + (state >> 32)
        at = (state & 0xFFFFFFFF) % count
        out.append(left[at])
        left[at] = left[count - 1]
    return out


def hough_segments(edges: np.ndarray, votes: int = 100, least: int = 0, gap: int = 10, angles: int = 180) -> list[tuple[int, int, int, int]]:
    """Segments (x1, y1, x2, y2) by the progressive probabilistic Hough transform.

    Edge points in a random order vote for lines through them, in steps of a pixel and of a half turn by angles. As soon as a line has enough votes, its points are
    walked along both ways from the voter to the first gap above gap and taken out; of a segment at least so long in x or y their votes are taken back.
    """
    h, w = edges.shape
    y, x = np.nonzero(edges)
    if len(y) < votes:
        return []
    turn = np.arange(angles) * float(np.float32(np.pi / angles))
    cos, sin = np.cos(turn).astype(np.float32), np.sin(turn).astype(np.float32)
    rhos = (w + h) * 2 + 1
    bins = (np.arange(angles) * rhos + (rhos - 1) // 2).astype(np.int64)
    table = np.zeros(angles * rhos, np.int32)
    mask, found = edges.copy(), []

    def voted(y, x):
        """For each point its bin at every angle."""
        return np.rint(np.multiply.outer(x.astype(np.float32), cos) + np.multiply.outer(y.astype(np.float32), sin)).astype(np.int64) + bins

    order = np.array(_shuffled(len(y)))
    y, x = y[order], x[order]
    at, size = 0, 64
    while at < len(y):
        # Points that bring no line to enough votes are counted many at a time; the first that does is looked for one by one.
        ys, xs = y[at : at + size], x[at : at + size]
        alive = np.flatnonzero(mask[ys, xs])
        into = voted(ys[alive], xs[alive])
        np.add.at(table, into.ravel(), 1)
        if not len(alive) or table[into].max() < votes:
            at, size = at + len(ys), min(2 * size, 256)
            continue
        np.subtract.at(table, into.ravel(), 1)
        for k, at_bins in zip(alive.tolist(), into, strict=True):
            table[at_bins] += 1
            n = int(table[at_bins].argmax())
            if table[at_bins[n]] >= votes:
                break
        at, size = at + k + 1, max(size // 2, 8)
        ends, paths = [], []
        for way in (1, -1):
            i, j = _path(int(ys[k]), int(xs[k]), -float(sin[n]), float(cos[n]), way, h, w)
            on = np.flatnonzero(mask[i, j])
            far = np.flatnonzero(np.diff(on) > gap + 1)
            last = int(on[far[0]] if len(far) else on[-1])
            ends.append((int(j[last]), int(i[last])))
            paths.append((i[: last + 1], j[: last + 1]))
        (x1, y1), (x2, y2) = ends
        good = abs(x2 - x1) >= least or abs(y2 - y1) >= least
        for i, j in paths:
            if good:
                on = mask[i, j]
                np.subtract.at(table, voted(i[on], j[on]).ravel(), 1)
            mask[i, j] = False
        if good:
            found.append((x1, y1, x2, y2))
    return found


def _path(y: int, x: int, a: float, b: float, way: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels from (y, x) on along the direction (a, b), x first, to the border, a pixel a step in the greater of both; the other goes in 65536ths."""
    flat = abs(a) > abs(b)
    if flat:
        main, side, to, slope = x, y, 1 if a > 0 else -1, round(b * 65536 / abs(a))
    else:
        main, side, to, slope = y, x, 1 if b > 0 else -1, round(a * 65536 / abs(b))
    most, wide = (w, h) if flat else (h, w)
    n = most - main if to * way > 0 else main + 1
    t = np.arange(n)
    m, s = main + to * way * t, ((side << 16) + 32768 + slope * way * t) >> 16
    beyond = np.flatnonzero((s < 0) | (s >= wide))
    if len(beyond):
        m, s = m[: beyond[0]], s[: beyond[0]]
    return (s, m) if flat else (m, s)


#: IMG4 looks for lines in steps of a degree.
DEGREES = 180


def line_angles(a: np.ndarray, most: float = 8.0, part: float = 0.15, angles: int = 720) -> list[float]:
    """The angles of the text lines' edges up to most degrees: those of the Hough segments that cover a part of the width. angles: steps in a half turn."""
    edges = canny(_stripes(gray(a) <= 200) * np.uint8(255))
    found = [float(np.degrees(np.arctan2(y2 - y1, x2 - x1))) for x1, y1, x2, y2 in hough_segments(edges, 100, int(a.shape[1] * part), angles=angles)]
    return [t for t in (t + 180 if t < -90 else t - 180 if t > 90 else t for t in found) if -most <= t <= most]


def skew(a: np.ndarray, angles: int = 720) -> float:
    """IMG4: the median angle of the text lines; none, or one above 5 degrees, counts as 0. The pages' functions below take DEGREES, as the named method does; finer steps tell half degrees apart."""
    found = line_angles(a, angles=angles)
    at = float(np.median(found)) if found else 0.0
    return 0.0 if abs(at) > 5 else at


def rotated_size(height: Column, width: Column, angle: Column) -> tuple[Column, Column]:
    """IMG5: the canvas that holds a page turned by an angle in degrees."""
    s, c = F.abs(F.sin(F.radians(angle))), F.abs(F.cos(F.radians(angle)))
    return F.floor(height * c + width * s).cast("int"), F.floor(height * s + width * c).cast("int")


def rotate(a: np.ndarray, angle: float, least: float = 0.8, swapped_border: bool = False, back: bool = False) -> np.ndarray:
    """IMG5: turned by -angle on a canvas that holds it, by linear interpolation, the border in the mean colour.

    Angles of turns count against the clock and those of lines, as skew() gives them, with it: so a tilted page is
    tilted on, as existing pages were; back turns it straight. swapped_border: with red and blue exchanged, as those pages have it.
    """
    if abs(angle) < least:
        return a
    angle = -angle if back else angle
    h, w = a.shape[:2]
    s, c = np.sin(np.radians(-angle)), np.cos(np.radians(-angle))
    nh, nw = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    border = a.reshape(-1, 3).mean(axis=0)
    wide = np.empty((h + 2, w + 2, 3))
    wide[:] = border[::-1] if swapped_border else border
    wide[1:-1, 1:-1] = a
    y, x = np.mgrid[:nh, :nw]
    y, x = y - nh / 2, x - nw / 2
    sy, sx = np.clip(s * x + c * y + h / 2 + 1, 0, h + 1), np.clip(c * x - s * y + w / 2 + 1, 0, w + 1)
    y0, x0 = np.minimum(sy.astype(int), h), np.minimum(sx.astype(int), w)
    fy, fx = (sy - y0)[:, :, None], (sx - x0)[:, :, None]
    top = wide[y0, x0] * (1 - fx) + wide[y0, x0 + 1] * fx
    low = wide[y0 + 1, x0] * (1 - fx) + wide[y0 + 1, x0 + 1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def max_side_size(height: Column, width: Column, most: int) -> tuple[Column, Column]:
    """IMG7: the longer side at most so long; 0 leaves it."""
    big = F.greatest(height, width)
    fits = F.lit(most <= 0) | (big <= most)
    return F.when(fits, height).otherwise(F.floor(height * F.lit(float(most)) / big)).cast("int"), F.when(fits, width).otherwise(F.floor(width * F.lit(float(most)) / big)).cast("int")


def pixel_budget_size(height: Column, width: Column, most: int = MAX_PIXELS) -> tuple[Column, Column]:
    """IMG8: at most so many pixels; halves go to the even number."""
    scale = F.sqrt(F.lit(float(most)) / (height.cast("double") * width))
    fits = height.cast("long") * width <= most
    return F.when(fits, height).otherwise(F.greatest(F.lit(1), F.bround(height * scale))).cast("int"), F.when(fits, width).otherwise(F.greatest(F.lit(1), F.bround(width * scale))).cast("int")


def _lanczos(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """A row of weights over the old pixels for each new one: a windowed sinc, as wide as the picture shrinks."""
    scale = max(old / new, 1.0)
    x = (np.arange(old)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * old / new) / scale
    weights = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """IMG7's pixels: Lanczos over rows, then over columns."""
    rows = np.tensordot(_lanczos(a.shape[0], height), a.astype(float), axes=(1, 0))
    both = np.tensordot(_lanczos(a.shape[1], width), rows, axes=(1, 1)).transpose(1, 0, 2)
    return np.rint(np.clip(both, 0, 255)).astype(np.uint8)


def to_png(a: np.ndarray) -> bytes:
    """IMG6: a BGR array as an RGB PNG."""
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a[:, :, ::-1].reshape(h, -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


BLANK_SIDE = 224


def blank_page() -> bytes:
    """SRC18: what stands for a missing image."""
    return b"\xff" * (BLANK_SIDE * BLANK_SIDE * 3)


def or_blank(ids: DataFrame, images: DataFrame, key: str = "id") -> DataFrame:
    """SRC18: each id with its image (height, width, data), a white one where it is missing."""
    return ids.select(key).join(images.select(key, "height", "width", "data"), key, "left").select(key, *(F.when(F.col("data").isNull(), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in (("height", BLANK_SIDE), ("width", BLANK_SIDE), ("data", blank_page()))))


_FEATURES = T.StructType([T.StructField(c, T.IntegerType() if c in ("words", "paper") else T.DoubleType()) for c in ("dark", "ink", "words", "paper", "skew")])


def _pages(data: pa.Array, height: pa.Array, width: pa.Array):
    """The pixels of each page, one after the other."""
    for d, h, w in zip(data, height.to_pylist(), width.to_pylist(), strict=True):
        buffer = d.as_buffer()
        yield pixels(buffer, h, w, len(buffer) // (h * w))


@F.arrow_udf(_FEATURES)
def page_features(data: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """All the raster features of a page in one crossing."""
    rows = []
    for a in _pages(data, height, width):
        g = gray(a)
        part, words = ink(g)
        rows.append((dark_ratio(g), part, words, paper_colour(g), skew(g, DEGREES)))
    return _columns(rows, _FEATURES)


_DARK = T.StructType([T.StructField("dark", T.DoubleType()), T.StructField("ink", T.DoubleType())])


@F.arrow_udf(_DARK)
def dark_and_ink(data: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """FIL2 and FIL3's percent of ink, without blobs and lines."""
    return _columns([(dark_ratio(g), ink_percent(g)) for g in map(gray, _pages(data, height, width))], _DARK)


def _columns(rows: list[tuple], schema: T.StructType) -> pa.Array:
    kinds = [pa.int32() if f.dataType == T.IntegerType() else pa.float64() for f in schema.fields]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)


def dark_percent(threshold: int = 210):
    """FIL2 as a function of (data, height, width)."""

    @F.arrow_udf("double")
    def percent(data: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        return pa.array([dark_ratio(a, threshold) for a in _pages(data, height, width)], pa.float64())

    return percent


#: What a batch of pages that a stage made may hold, but for its last page.
_MADE_BYTES = 4 << 20


def made_pages(batches, f, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (id, height, width, data) with f(pixels) in place of data, in batches of bounded bytes."""
    for b in batches:
        rows, held = [], 0
        for i, a in enumerate(_pages(*(b.column(c) for c in ("data", "height", "width")))):
            made = f(a)
            a, data = made if isinstance(made, tuple) else (made, made.tobytes())
            rows.append({"id": b.column("id")[i].as_py(), "height": a.shape[0], "width": a.shape[1], schema.names[-1]: data})
            held += len(data)
            if held >= _MADE_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def _each_page(images: DataFrame, f, out: str) -> DataFrame:
    """Rows (id, height, width, data) with f(pixels) in place of data: an array, kept as bytes, or bytes."""
    schema = pa.schema([("id", pa.string()), ("height", pa.int32()), ("width", pa.int32()), (out, pa.binary())])
    rows = images.select("id", "height", "width", "data")
    return rows.mapInArrow(lambda batches: made_pages(batches, f, schema), f"id string, height int, width int, {out} binary")


def cropped_pages(images: DataFrame, percent: float = 10.0) -> DataFrame:
    """IMG2 on every page."""
    return _each_page(images, lambda a: whiteout(a, percent), "data")


def straight_pages(images: DataFrame, back: bool = False) -> DataFrame:
    """IMG4 and IMG5 on every page; back: see rotate()."""
    return _each_page(images, lambda a: np.ascontiguousarray(rotate(a, skew(a, DEGREES), back=back)), "data")


def _fit(a: np.ndarray, most: int) -> np.ndarray:
    big = max(a.shape[:2])
    return resize(a, int(a.shape[0] * most / big), int(a.shape[1] * most / big)) if 0 < most < big else a


def encoded_pages(images: DataFrame, most: int = 2048) -> DataFrame:
    """IMG6 and IMG7 on every page: (id, height, width, png)."""

    def encode(a):
        a = _fit(a, most)
        return a, to_png(a)

    return _each_page(images, encode, "png")


def clean_pages(images: DataFrame, percent: float = 10.0, most: int = 2048) -> DataFrame:
    """IMG2, IMG4 to IMG7 in order, in one crossing: images (id, height, width, data) as PNG rows (id, height, width, png)."""

    def clean(a):
        a = whiteout(a, percent)
        a = _fit(rotate(a, skew(a, DEGREES)), most)
        return a, to_png(a)

    return _each_page(images, clean, "png")
