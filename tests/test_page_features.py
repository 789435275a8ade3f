"""The steps of FIL3 and IMG4 against plain loops: outer contours and their areas, Canny's edges, segments of the probabilistic Hough transform."""

import math

import numpy as np
import pyarrow as pa
import pytest

from vellum.functions import images

AROUND = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]  # against the clock from the right


def area_by_border(m, y, x):
    """The polygon that border following walks around the blob whose first pixel in reading order is (y, x)."""

    def on(p):
        return 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and bool(m[p])

    def step(p, d):
        return p[0] + AROUND[d % 8][0], p[1] + AROUND[d % 8][1]

    first = next((d for d in range(4, -4, -1) if on(step((y, x), d))), None)  # with the clock from the left
    if first is None:
        return 0.0
    end, here, back, twice = step((y, x), first), (y, x), first % 8, 0
    while True:
        d = next(d for d in range(back + 1, back + 9) if on(step(here, d)))
        there = step(here, d)
        twice += here[1] * there[0] - there[1] * here[0]
        if there == (y, x) and here == end:
            return abs(twice) / 2
        here, back = there, (d + 4) % 8


def flood(m, y, x, near):
    todo, seen = [(y, x)], {(y, x)}
    while todo:
        i, j = todo.pop()
        for a, b in near:
            p = (i + a, j + b)
            if 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and m[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def areas_by_force(m):
    outside = {(y - 1, x - 1) for y, x in flood(np.pad(~m, 1, constant_values=True), 0, 0, AROUND[::2])}
    left, out = {tuple(p) for p in np.argwhere(m).tolist()}, []
    for p in sorted(left):
        if p in left:
            left -= flood(m, *p, AROUND)
            if (p[0], p[1] - 1) in outside:  # else it lies in a hole
                out.append(area_by_border(m, *p))
    return sorted(out)


def test_contours_are_the_outermost_and_hold_polygons():
    rng = np.random.default_rng(1)
    for density in (0, 0.1, 0.3, 0.5, 0.6, 0.7, 0.9, 1) * 25:
        m = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < density
        assert sorted(images.contour_areas(m)) == areas_by_force(m)


def features(page):
    h, w = page.shape[:2]
    return images.page_features.func(pa.array([page.tobytes()]), pa.array([h]), pa.array([w])).to_pylist()[0]


def test_words_are_outer_contours_above_ten():
    page = np.full((60, 80), 255, np.uint8)
    page[0, 40] = 0  # grown to 3 x 5 pixels, between whose middles lie 2 x 4
    assert features(page)["words"] == 0
    page[30, 40] = 0  # 4 x 4
    assert features(page)["words"] == 1
    page[20:22, 20:60] = page[40:42, 20:60] = page[20:42, 20:22] = page[20:42, 58:60] = 0  # a frame around it
    assert features(page)["words"] == 1


def canny_by_force(m):
    h, w = m.shape
    p = np.pad(m.astype(int), 1, mode="edge")
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            n = p[y : y + 3, x : x + 3]
            dx[y, x] = n[0, 2] + 2 * n[1, 2] + n[2, 2] - n[0, 0] - 2 * n[1, 0] - n[2, 0]
            dy[y, x] = n[2, 0] + 2 * n[2, 1] + n[2, 2] - n[0, 0] - 2 * n[0, 1] - n[0, 2]
    size = np.pad(abs(dx) + abs(dy), 1)
    thin = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            at, i, j = size[y + 1, x + 1], y + 1, x + 1
            if at <= 50:
                continue
            gx, gy = int(abs(dx[y, x])), int(abs(dy[y, x])) << 15
            if gy < gx * 13573:
                thin[y, x] = at > size[i, j - 1] and at >= size[i, j + 1]
            elif gy > gx * 13573 + (gx << 16):
                thin[y, x] = at > size[i - 1, j] and at >= size[i + 1, j]
            else:
                s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
                thin[y, x] = at > size[i - 1, j - s] and at > size[i + 1, j + s]
    out = np.zeros((h, w), bool)
    for y, x in np.argwhere(thin & (size[1:-1, 1:-1] > 150)).tolist():
        if not out[y, x]:
            for q in flood(thin, y, x, AROUND):
                out[q] = True
    return out


def test_edges_by_force():
    rng = np.random.default_rng(2)
    for k in range(40):
        shape = tuple(rng.integers(1, 24, 2))
        m = rng.integers(0, 256, shape) if k % 4 == 0 else rng.integers(100, 100 + 12 * (k % 4), shape) if k % 4 < 3 else (rng.random(shape) < 0.5) * 255
        assert (images.canny(m.astype(np.uint8)) == canny_by_force(m)).all()


def segments_by_force(edges, votes, least, gap):
    h, w = edges.shape
    points, mask, out = [(y, x) for y in range(h) for x in range(w) if edges[y, x]], edges.copy(), []
    rhos, f = 2 * (w + h) + 1, np.float32
    turn = [n * float(f(math.pi / 180)) for n in range(180)]
    trig = [(f(math.cos(t)), f(math.sin(t))) for t in turn]
    table, state = np.zeros((180, rhos), int), (1 << 64) - 1

    def bins(i, j):
        return [round(float(f(f(j) * c) + f(f(i) * s))) + (rhos - 1) // 2 for c, s in trig]

    for count in range(len(points), 0, -1):
        state = (state & 0xFFFFFFFF) * 4164903690 + (state >> 32)
        at = (state & 0xFFFFFFFF) % count
        y, x = points[at]
        points[at] = points[count - 1]
        if not mask[y, x]:
            continue
        most, best = votes - 1, 0
        for n, r in enumerate(bins(y, x)):
            table[n, r] += 1
            if table[n, r] > most:
                most, best = table[n, r], n
        if most < votes:
            continue
        a, b = -float(trig[best][1]), float(trig[best][0])
        flat = abs(a) > abs(b)
        x0, y0 = x, y
        if flat:
            dx, dy, y0 = (1 if a > 0 else -1), round(b * 65536 / abs(a)), (y << 16) + 32768
        else:
            dy, dx, x0 = (1 if b > 0 else -1), round(a * 65536 / abs(b)), (x << 16) + 32768

        def walk(way, x0=x0, y0=y0, dx=dx, dy=dy, flat=flat):
            i, j = y0, x0
            while True:
                p = (i >> 16, j) if flat else (i, j >> 16)
                if not (0 <= p[0] < h and 0 <= p[1] < w):
                    return
                yield p
                i, j = i + way * dy, j + way * dx

        ends = []
        for way in (1, -1):
            missing = 0
            for p in walk(way):
                if mask[p]:
                    missing, end = 0, p
                else:
                    missing += 1
                    if missing > gap:
                        break
            ends.append(end)
        (y1, x1), (y2, x2) = ends
        good = abs(x2 - x1) >= least or abs(y2 - y1) >= least
        for way, end in zip((1, -1), ends, strict=True):
            for p in walk(way):
                if mask[p]:
                    if good:
                        for n, r in enumerate(bins(*p)):
                            table[n, r] -= 1
                    mask[p] = False
                if p == end:
                    break
        if good:
            out.append((x1, y1, x2, y2))
    return out


@pytest.mark.parametrize("votes, least, gap", [(40, 12, 10), (20, 30, 2), (12, 0, 0)])
def test_segments_by_force(votes, least, gap):
    rng = np.random.default_rng(votes)
    edges = rng.random((70, 110)) < 0.03
    for k in range(9):
        x = np.arange(5, 105)
        y = np.rint(8 * k + np.tan(np.radians(2 * k - 8)) * (x - 55)).astype(int)
        on = (y >= 0) & (y < 70) & (rng.random(100) < 0.9)
        edges[y[on], x[on]] = True
    edges[10:60, 30] = True
    got = images.hough_segments(edges, votes, least, gap)
    assert len(got) > 3 and got == segments_by_force(edges, votes, least, gap)


def test_stripes_reach_as_the_kernel_does():
    dark = np.zeros((1, 400), bool)
    dark[0, 200] = True
    assert np.flatnonzero(images._stripes(dark)[0]).tolist() == list(range(177, 227))  # grown by 48 before and 50 behind, less 25 and 24
    dark[0, 320] = dark[0, 330] = True
    assert not images._stripes(dark)[0, 240] and images._stripes(dark)[0, 320:331].all()


def test_a_pages_skew_is_the_median_of_segments():
    page = np.full((500, 600), 255, np.uint8)
    for row in range(60, 440, 40):
        for x in range(40, 560):
            y = round(row + math.tan(math.radians(1.5)) * (x - 300))
            page[y : y + 9, x] = 0
    edges = images.canny(images._stripes(page <= 200) * np.uint8(255))
    found = [math.degrees(math.atan2(d - b, c - a)) for a, b, c, d in segments_by_force(edges, 100, 90, 10)]
    assert features(page)["skew"] == pytest.approx(np.median([t for t in found if -8 <= t <= 8]))
