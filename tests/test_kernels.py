"""The image kernels against plain Python, one pixel at a time."""

import math

import numpy as np
import pytest

from scanlake.operators import kernels
from scanlake.plans.kernels import glyph, page


def plain_stretch(img):
    flat = sorted(img.ravel().tolist())
    n = len(flat)
    low, high = (flat[t - 1] if t else 0 for t in (n // 100, n * 99 // 100))
    if low >= high:
        return img.astype(int)
    return np.array([[min(255, max(0, math.floor(float(np.float32(v - low) * np.float32(255) / np.float32(high - low)) + 0.5))) for v in r] for r in img.astype(int)])


def flood(cells, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        y, x = todo.pop()
        for c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if c in cells and c not in seen:
                seen.add(c)
                todo.append(c)
    return seen


def plain_thin(ink, h, w):
    now = set(ink)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = len(now)
        for step in (0, 1):
            gone = set()
            for y, x in now:
                if not (0 < y < h - 1 and 0 < x < w - 1):
                    continue
                p = [(y + a, x + b) in now for a, b in ring]
                if 2 <= sum(p) <= 6 and sum(not p[k] and p[(k + 1) % 8] for k in range(8)) == 1:
                    u, r, d, le = p[0], p[2], p[4], p[6]
                    if not ((u and r and d) or (r and d and le)) if step == 0 else not ((u and r and le) or (u and d and le)):
                        gone.add((y, x))
            now -= gone
        if len(now) == before:
            return now


def plain_descriptor(img):
    img = plain_stretch(img)
    full_h, full_w = img.shape
    dark = [(y, x) for y in range(full_h) for x in range(full_w) if img[y, x] < 240]
    if not dark:
        return None
    y0, x0 = min(y for y, _ in dark), min(x for _, x in dark)
    h, w = max(y for y, _ in dark) - y0 + 1, max(x for _, x in dark) - x0 + 1
    ink = {(y - y0, x - x0) for y, x in dark}
    value = lambda y, x: 255 - img[y + y0, x + x0] if (y, x) in ink else 0
    col, row = [sum(value(y, x) for y in range(h)) for x in range(w)], [sum(value(y, x) for x in range(w)) for y in range(h)]
    total = sum(col)

    def profile(a):
        out = []
        for k in range(16):
            at = k * (len(a) - 1) / 15
            lo = math.floor(at)
            out.append((a[lo] * (1 - at + lo) + a[min(lo + 1, len(a) - 1)] * (at - lo)) / max(a))
        return out

    counts = [sum((y, x) in ink for x in range(w)) for y in range(h)]
    serif = 0.0
    if h >= 8 and full_w >= 3:
        e = min(4, max(2, h // 8))
        middle = sum(counts[h // 3 : 2 * h // 3]) / max(1, 2 * h // 3 - h // 3)
        if middle >= 1:
            serif = min(1, max(0, (sum(counts[:e]) / e / middle + sum(counts[-e:]) / e / middle) / 2 - 1))
    runs = []
    for line in [[(y, x) for x in range(full_w)] for y in range(full_h)] + [[(y, x) for y in range(full_h)] for x in range(full_w)]:
        n = 0
        for y, x in [*line, (None, None)]:
            if y is not None and img[y, x] < 240:
                n += 1
            else:
                runs += [n] * (n >= 2)
                n = 0
    runs.sort()
    large = full_w >= 4 and full_h >= 4
    contrast = 1 - max(runs[len(runs) // 10], 1) / max(runs[len(runs) * 9 // 10], 1) if large and len(runs) >= 4 else 1.0
    white = {(y, x) for y in range(h) for x in range(w)} - ink
    hole = white - flood(white, [(y, x) for y, x in white if y in (0, h - 1) or x in (0, w - 1)])
    counter = [0.0] * 4
    if hole:
        hy, hx = [y for y, _ in hole], [x for _, x in hole]
        counter = [len(hole) / (h * w), sum(hx) / len(hole) / w, sum(hy) / len(hole) / h, (max(hx) - min(hx) + 1) / (max(hy) - min(hy) + 1)]
    n_holes, left = 0, set(hole)
    while left:
        left -= flood(left, [min(left)])
        n_holes += 1
    ways = [0] * 4
    near = lambda y, x: [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (y + a, x + b) in ink]
    if h >= 3 and w >= 3:
        for y, x in ink:
            if len(only := near(y, x)) == 1:
                deg = math.degrees(math.atan2(0 - only[0][0], 0 - only[0][1]))
                ways[0 if -135 <= deg < -45 else 1 if -45 <= deg < 45 else 2 if 45 <= deg < 135 else 3] += 1
    four = lambda y, x: [(y - 1, x) in ink, (y, x + 1) in ink, (y + 1, x) in ink, (y, x - 1) in ink]
    boundary = sum(not all(four(y, x)) for y, x in ink)
    crossings = []
    for k in range(4):
        y = min(h - 1, int((k + 1) * h / 5))
        crossings.append(min(1, sum(((y, x) in ink) != ((y, x - 1) in ink) for x in range(1, w)) / 20))
    sym = [0.0, 0.0]
    if h >= 2 and w >= 2:
        a = [((y, x) in ink) == ((y, w - 1 - x) in ink) for y in range(h) for x in range(w // 2)]
        b = [((y, x) in ink) == ((h - 1 - y, x) in ink) for y in range(h // 2) for x in range(w)]
        sym = [sum(a) / len(a), sum(b) / len(b)]
    branch = ends = corners = 0
    if h >= 3 and w >= 3:
        bones = plain_thin(ink, h, w)
        for y, x in bones:
            if 0 < y < h - 1 and 0 < x < w - 1:
                d = sum((y + a, x + b) in bones for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
                branch, ends = branch + (d >= 3), ends + (d == 1)
        if boundary >= 5:
            for y, x in ink:
                if 0 < y < h - 1 and 0 < x < w - 1:
                    u, r, d, le = four(y, x)
                    if u + r + d + le == 2 and not (u and d) and not (r and le):
                        corners += (y + (-1 if u else 1), x + (1 if r else -1)) not in ink
    quarters = []
    for top in (True, False):
        for near_side in (True, False):
            cells = [(y, x) for y in range(h) for x in range(w) if (y < h // 2) == top and (x < w // 2) == near_side]
            quarters.append(sum(c in ink for c in cells) / len(cells) if cells else 0)
    mid = (w - 1) // 2
    return [
        *profile(col), w / h, len(ink) / (h * w), sum((y + y0) * row[y] for y in range(h)) / total / full_h, sum(col[: mid + 1]) / total, serif, contrast, *counter,
        *[x / sum(ways) if sum(ways) else 0 for x in ways], min(1, boundary / math.sqrt(len(ink)) / 10), 4 * math.pi * len(ink) / boundary**2, *crossings, *profile(row),
        min(1, n_holes / 4), *sym, min(1, branch / 10), min(1, ends / 10), min(1, corners / 20), *quarters, sum(runs) / len(runs) / full_h if large and runs else 0,
    ]


def test_descriptors_against_plain_python():
    rng = np.random.default_rng(3)
    cases = [glyph(i, rng.normal(0, 0.4, 64)) for i in range(60)]
    cases += [rng.choice([0, 90, 255], (int(h), int(w)), p=[0.3, 0.1, 0.6]).astype(np.uint8) for h, w in rng.integers(1, 14, (60, 2))]
    cases += [np.full((6, 6), 255, np.uint8), np.full((6, 6), 0, np.uint8), np.full((1, 1), 7, np.uint8)]
    for img in cases:
        want, got = plain_descriptor(img), kernels.descriptor(img)
        assert (want is None) == (got is None)
        if want is not None:
            assert np.allclose(got, want, atol=2e-5), (img.shape, [(k, a, b) for k, (a, b) in enumerate(zip(got, want, strict=True)) if abs(a - b) > 2e-5])


def test_descriptors_of_a_batch_are_those_of_each():
    rng = np.random.default_rng(5)
    imgs = rng.choice([0, 255], (40, 15, 11), p=[0.35, 0.65]).astype(np.uint8)
    imgs[7] = 255
    found, has = kernels.descriptors(imgs)
    assert not has[7] and has.sum() == 39
    assert all(np.array_equal(found[k], kernels.descriptor(x)) for k, x in enumerate(imgs) if k != 7)


def plain_histogram(img):
    h, w = img.shape
    scale = min(24 / w, 24 / h)
    size = [max(1, math.floor(k * scale + 0.5)) for k in (h, w)]

    def resize(a, new):  # along the first axis
        ratio = a.shape[0] / new
        wide, out = max(ratio, 1), []
        for k in range(new):
            middle = (k + 0.5) * ratio
            ks = range(max(0, math.floor(middle - 3 * wide)), min(a.shape[0], math.ceil(middle + 3 * wide)))
            sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
            ws = [(lambda t: sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0)((j - middle + 0.5) / wide) for j in ks]
            out.append(sum(wt * a[j] for wt, j in zip(ws, ks, strict=True)) / sum(ws))
        return np.array(out)

    small = img.astype(float) if (h, w) == tuple(size) else np.floor(np.clip(resize(resize(img.astype(float), size[0]).T, size[1]).T, 0, 255) + 0.5)
    sq = np.full((24, 24), 255.0)
    oy, ox = (24 - size[0]) // 2, (24 - size[1]) // 2
    sq[oy : oy + size[0], ox : ox + size[1]] = small
    out = np.zeros(128)
    for y in range(24):
        for x in range(24):
            dx = sq[y, 1] - sq[y, 0] if x == 0 else sq[y, 23] - sq[y, 22] if x == 23 else (sq[y, x + 1] - sq[y, x - 1]) / 2
            dy = sq[1, x] - sq[0, x] if y == 0 else sq[23, x] - sq[22, x] if y == 23 else (sq[y + 1, x] - sq[y - 1, x]) / 2
            if (size_ := math.hypot(dx, dy)) >= 1e-6:
                place = (math.atan2(dy, dx) % math.pi) / (math.pi / 8)
                at = (y // 6 * 4 + x // 6) * 8
                out[at + int(place) % 8] += size_ * (1 - place % 1)
                out[at + (int(place) + 1) % 8] += size_ * (place % 1)
    return out / np.linalg.norm(out) if np.linalg.norm(out) > 1e-6 else out


@pytest.mark.parametrize("shape", [(24, 24), (10, 20), (24, 13), (40, 31), (3, 9), (60, 6)])
def test_gradient_histograms_against_plain_python(shape):
    rng = np.random.default_rng(shape[0])
    img = np.kron(rng.integers(0, 255, (-(-shape[0] // 3), -(-shape[1] // 3))), np.ones((3, 3)))[: shape[0], : shape[1]].astype(np.uint8)
    got, ok = kernels.gradient_histograms(np.stack([img, img[::-1]]))
    assert ok.all() and np.allclose(got[0], plain_histogram(img), atol=0.02) and np.allclose(got[1], plain_histogram(img[::-1]), atol=0.02)
    assert np.abs(got[0] - plain_histogram(img)).mean() < 1e-3


def plain_skew(img):
    """The rules one vote at a time; also the best angle before the checks."""
    edges = kernels.skew_edges(img)
    h, w = edges.shape
    votes: list[dict] = []
    for k in range(201):
        t = np.radians(np.float32(85) + np.float32(k) * np.float32(0.05))
        bins: dict = {}
        for y, x in zip(*np.nonzero(edges), strict=True):
            rho = float(np.float32(x) * np.cos(t) + np.float32(y) * np.sin(t))
            rho = int(math.copysign(math.floor(abs(np.float32(rho)) + 0.5), rho))
            bins[rho] = bins.get(rho, 0) + 1
        votes.append(bins)
    top = max((v for b in votes for v in b.values()), default=0)
    if top < 10:
        return 0.0, 0.0
    limit = int(top * 0.3)
    sums = [sum(v for v in b.values() if v >= limit) for b in votes]
    best = max(range(201), key=lambda k: (sums[k], k))
    angle = (best - 100) * 0.05
    rest = [s for k, s in enumerate(sums) if abs(k - best) > 1]
    if not 0 < best < 200 or sums[best] < 2 * sum(sums) / 201 or sums[best] < 1.5 * max(rest):
        return angle, 0.0
    bend = 2 * sums[best] - sums[best - 1] - sums[best + 1]
    lines = sorted(r for r, v in votes[best].items() if v >= limit)
    bands = 1 + sum(b - a > 20 for a, b in zip(lines, lines[1:], strict=False))
    if bend <= 0.05 * sums[best] or bands < 2:
        return angle, 0.0
    return angle, angle + (sums[best + 1] - sums[best - 1]) / (2 * bend) * 0.05


@pytest.mark.parametrize("degrees", [-1.6, 0.0, 0.9])
def test_skew_against_plain_python(degrees):
    img = kernels.rotated(page(3, np.zeros(1)), degrees)
    best, found = plain_skew(img)
    assert kernels.skew_degrees(img, sure=False) == pytest.approx(best, abs=1e-4) and kernels.skew_degrees(img) == pytest.approx(found, abs=1e-3)
    assert abs(abs(best) - abs(degrees)) < 0.4
    assert kernels.skew_degrees(np.full((50, 50), 255, np.uint8)) == 0.0


def test_skew_edges():
    img = np.full((30, 1200), 255, np.uint8)
    img[10:20, 100:1100] = 0
    edges = kernels.skew_edges(img)
    assert edges.shape == (15, 600) and edges[5, 300] and not edges[7, 300] and not edges[0].any()


def test_blur_and_trims():
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    at = lambda a, y, x: int(a[min(max(y, 0), 4), min(max(x, 0), 6)])
    rows = np.array([[(at(img, y, x - 1) + 2 * at(img, y, x) + at(img, y, x + 1) + 2) // 4 for x in range(7)] for y in range(5)])
    want = np.array([[(at(rows, y - 1, x) + 2 * at(rows, y, x) + at(rows, y + 1, x) + 2) // 4 for x in range(7)] for y in range(5)])
    assert (kernels.blurred(img) == want).all() and (kernels.blurred(img[:2]) == img[:2]).all()
    page_ = np.full((30, 200), 255, np.uint8)
    page_[5:25, 30:170] = 10
    page_[2, 100] = 0  # one pixel of 200 is less than a hundredth of its row
    assert kernels.trimmed(page_).shape == (20, 140) and kernels.ink_cropped(page_).shape == (23, 140) and kernels.trimmed(page_[:5]).shape == (5, 200)
    assert kernels.trimmed_ssim(page_, page_) == pytest.approx(1.0) and kernels.trimmed_ssim(page_, np.pad(page_, 9, constant_values=255)) == pytest.approx(1.0)
    assert kernels.gaussian().sum() == pytest.approx(1.0) and kernels.gaussian()[5, 5] == kernels.gaussian().max()


def test_correlations():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (20, 15)).astype(np.uint8)
    b = np.full((20, 15), 255, np.uint8)
    b[2:] = a[:-2]
    pairs = [(float(a[y, x]), float(b[y + 1, x]) if y + 1 < 20 else 255.0) for y in range(20) for x in range(15)]
    assert kernels.correlation(a, b, 1) == pytest.approx(np.corrcoef(*zip(*pairs, strict=True))[0, 1])
    value, dy = kernels.best_correlation(a, b)
    assert dy == 2 and value > 0.85 and kernels.correlation(a, np.full((20, 15), 9, np.uint8)) == 1.0 and kernels.correlation(a[:1, :3], b) == 0.0
    other = rng.integers(0, 256, (20, 15)).astype(np.uint8)
    assert kernels.correlation(a, other, bail=0.9) >= kernels.correlation(a, other) and kernels.correlation(a, a, bail=0.9) == pytest.approx(1.0)


def test_words_are_refined_by_ink():
    from scanlake.operators import wordink as W

    img = np.full((20, 60), 255, np.uint8)
    img[5:15, 10:20] = 0
    img[5:15, 25:40] = 0
    one = W.Box(13, 7, 4, 5)
    W.expand([one], img, 240, 250, 5)
    assert (one.x, one.right, one.y, one.bottom) == (10, 20, 5, 15)
    a, b = W.Box(10, 5, 18, 10), W.Box(22, 5, 18, 10)
    W.part([a, b], img, 240)
    assert (a.right, b.x, b.right) == (20, 25, 40)
    a, b = W.Box(25, 5, 10, 10), W.Box(30, 5, 10, 10)  # no white space between the middles
    W.part([a, b], img, 240)
    assert a.right == 30 and b.x == 30
    wide = W.Box(5, 5, 18, 10)
    W.trim([wide], img, 240)
    assert (wide.x, wide.right) == (10, 20)
    empty = W.Box(45, 5, 10, 10)
    W.trim([empty], img, 240)
    assert (empty.x, empty.right) == (45, 55)
    img[5:15, 20] = 128  # a half-dark edge
    assert W.extent(img, (5, 15), (0, 24), 240) == pytest.approx((10.0, 20 + 127 / 255)) and W.extent(img, (5, 15), (45, 55), 240) == (45.0, 45.0)
    assert W.extent(img, (10, 20), (0, 20), 240, vertical=True) == (5.0, 15.0)
    assert W.walk(np.array([True, True, False, True]), 0, 4, True) == 2 and W.walk(np.array([True, False, True, True]), 4, 0, False) == 2
    assert W.fractional_edges(np.array([0, 3]), 15) is None


def test_crops_between_seams():
    img = np.full((6, 12), 255, np.uint8)
    img[1:5, 2:5], img[1:5, 6:9] = 0, 100
    seam = [(y, 5 + y % 2) for y in range(6)]
    left, x = kernels.seam_crop(img, 0, 5, None, seam)
    assert x == 0 and left.shape == (6, 7) and (left[:, 2:5] == img[:, 2:5]).all() and (left[0:6:2, 6] == 255).all()
    right, x = kernels.seam_crop(img, 5, 12, seam, None)
    assert x == 5 and right.shape == (6, 7) and (right[2, 1:4] == 100).all()
    assert kernels.seam_crop(img, 5, 6) is None and kernels.seam_crop(img, 5, 4) is None
    assert kernels.seam_limit(img, [(1, 5)], 1) == 6 and kernels.seam_limit(img, [(1, 5)], 0) is None
    assert kernels.character_metrics(img, 0, [0, 5, 12], {}) == (2, 4, 1, 4, 3.5, 3.0) and kernels.character_metrics(img, 2, [0, 5, 12], {}) is None
    assert kernels.sequence_crop(img, 0, 1, [0, 5, 12], {}).shape[0] == 24 and kernels.sequence_crop(img, 1, 2, [0, 5, 12], {}) is None
    assert kernels.ink_normalised(img, 6).shape == (6, 9) and kernels.ink_normalised(img[:1]) is None and kernels.ink_middle(img) == (5.0, 2.5) and kernels.ink_middle(img[:1]) is None


def test_paint_and_difference():
    img = np.zeros((5, 6, 3), np.uint8)
    out = kernels.painted(img, [(1, 1, 2, 1), (9, 9, 1, 1)], (9, 8, 7), 1)
    assert (out[0:3, 0:4] == (9, 8, 7)).all() and (out[3:] == 0).all() and (out[:, 4:] == 0).all() and (img == 0).all()
    a, b = np.full((2, 3), 255, np.uint8), np.full((2, 3), 255, np.uint8)
    a[0, 0] = a[1, 1] = b[1, 1] = b[0, 2] = 0
    d = kernels.coloured_difference(a, b)
    assert tuple(d[0, 0]) == (220, 30, 30) and tuple(d[0, 2]) == (30, 80, 220) and tuple(d[1, 1]) == tuple(d[1, 0]) == (255, 255, 255)
    assert kernels.coloured_difference(a, np.full((4, 6), 255, np.uint8)).shape == (2, 3, 3)


def test_images_written_and_read(spark, tmp_path):
    from scanlake.sources import files

    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 4)).astype(np.uint8), rng.integers(0, 256, (3, 6, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(kernels.png(grey))
    (tmp_path / "b.png").write_bytes(kernels.png(colour))
    (tmp_path / "c.png").write_bytes(b"none")
    got = {r["origin"][-5]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    r, g, b = (colour[:, :, k].astype(int) for k in range(3))
    want = ((2126 * r + 7152 * g + 722 * b) // 10000).astype(np.uint8)
    assert set(got) == {"a", "b"} and bytes(got["a"]["px"]) == grey.tobytes() and bytes(got["b"]["px"]) == want.tobytes() and (got["b"]["width"], got["b"]["height"]) == (6, 3)
    assert kernels.data_uri(grey).startswith("data:image/png;base64,iVBOR")
    rows = spark.createDataFrame([(1, 4, 5, grey.tobytes())], "id long, width int, height int, px binary")
    files.write_rasters(rows, f"{tmp_path}/r")
    assert bytes(files.read_rasters(spark, f"{tmp_path}/r").first()["px"]) == grey.tobytes()
    words = spark.createDataFrame([(1, k, f"w{k}", k, 2, 3, 4, 9.5, 90.0, 5, 1, 1, 1, k) for k in (2, 0, 1)], "page int, ord int, text string, x long, y long, width long, height long, font_size_pt double, confidence double, level long, block_num long, par_num long, line_num long, word_num long")
    files.write_words(words, f"{tmp_path}/w")
    assert [tuple(r) for r in files.read_words(spark, f"{tmp_path}/w").orderBy("ord").collect()] == sorted(tuple(r) for r in words.collect())
    assert [w["text"] for w in files.raw_boxes(words, ["page"], "ord").first()["raw_words"]] == ["w0", "w1", "w2"]


def test_word_widths():
    from scanlake.operators import wordink as W

    img = np.full((10, 40), 255, np.uint8)
    img[2:8, 5:15] = 0
    assert W.word_widths(img, [W.Box(100, 50, 20, 10), W.Box(120, 50, 9, 10), W.Box(900, 50, 7, 5)], 100, 50) == [10.0, 9.0, 7.0]
