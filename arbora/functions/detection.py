"""Kernels that find objects in images: components, contours, blobs, templates, descriptors, textures."""

from __future__ import annotations

import math

import numpy as np

from arbora.functions.kernels import blur, canny, correlate, gauss, image, odd, sobel_xy, windows
from arbora.functions.registry import Op, register


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Labels from 1 of connected true pixels, by spreading the least number until nothing changes."""
    h, w = mask.shape[1:]
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(1, h, w), 0)
    big = h * w + 1
    while True:
        p = np.pad(np.where(lab > 0, lab, big), ((0, 0), (1, 1), (1, 1)), constant_values=big)
        near = [p[:, 1:-1, 1:-1], p[:, :-2, 1:-1], p[:, 2:, 1:-1], p[:, 1:-1, :-2], p[:, 1:-1, 2:]]
        if diagonal:
            near += [p[:, :-2, :-2], p[:, :-2, 2:], p[:, 2:, :-2], p[:, 2:, 2:]]
        new = np.where(mask, np.minimum.reduce(near), 0)
        if (new == lab).all():
            return lab
        lab = new


def objects(lab: np.ndarray) -> list[np.ndarray]:
    """For one image's labels the pixels (row, column) of each object."""
    return [np.argwhere(lab == k) for k in np.unique(lab[lab > 0])]


def ragged(rows: list[list]) -> list[np.ndarray]:
    return [np.asarray(r, float).ravel() for r in rows]


@image("MaximumFilter", "1 where a pixel is the maximum around it and stands out by more than a threshold", size=3, threshold=27.0)
def maximum_filter(x, size=3, threshold=27.0):
    w = windows(x, max(1, int(size)), max(1, int(size)), "symmetric")
    return ((x == w.max(axis=(3, 4))) & (w.max(axis=(3, 4)) - w.min(axis=(3, 4)) > threshold)).astype(float)


@image("MinimumFilter", "1 where a pixel is the minimum around it and below a threshold", size=3, threshold=0.3)
def minimum_filter(x, size=3, threshold=0.3):
    low = windows(x, max(1, int(size)), max(1, int(size)), "symmetric").min(axis=(3, 4))
    return ((x == low) & (low < threshold)).astype(float)


@image("LabelObjects", "middle (row, column) of the box around each connected object")
def label_objects(x):
    return ragged([[(o.min(axis=0) + o.max(axis=0)) / 2 for o in objects(l)] for l in components(x > 0)])


@image("LabelByCenterOfMass", "centres (x, y) of the objects of the first image weighted by the second", inputs=2)
def label_by_mass(x, y):
    out = []
    for l, v in zip(components(x > 0), y):
        row = []
        for o in objects(l):
            m = v[o[:, 0], o[:, 1]]
            total = m.sum() or 1.0
            row.append([(m * o[:, 1]).sum() / total, (m * o[:, 0]).sum() / total])
        out.append(row)
    return ragged(out)


# --- contours ----------------------------------------------------------------------------------------------------------


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by two monotone chains."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]), float)


def polygon_area(p: np.ndarray) -> float:
    return abs(float((p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)).sum())) / 2 if len(p) > 2 else 0.0


def measures(o: np.ndarray) -> dict[str, float]:
    """Sizes of one object: area within its outline, length of the outline, box, hull, circle."""
    have = set(map(tuple, o.tolist()))
    edge = [p for p in have if not {(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)} <= have]
    hu = hull(o)
    height, width = (o.max(axis=0) - o.min(axis=0) + 1).tolist()
    area = max(float(len(have)) - len(edge) / 2 - 1, 0.0)  # Pick: the outline runs through the border pixels
    middle = hu.mean(axis=0)
    radius = float(np.hypot(*(hu - middle).T).max()) if len(hu) else 0.0
    hull_area = polygon_area(hu)
    circle = math.pi * radius**2
    return {
        "area": area, "length": float(len(edge)), "aspect": width / height, "extent": area / (width * height), "solidity": area / hull_area if hull_area else 0.0,
        "diameter": math.sqrt(4 * area / math.pi), "circle": circle, "circle_extent": area / circle if circle else 0.0, "convex": float(hull_area <= area + 0.5),
    }


def keep_contours(x, measure, low, high, edges=True):
    """Pixels of the outlines whose measure lies between two bounds."""
    mask = canny(x) > 0 if edges else x > 0
    out = np.zeros_like(x)
    for r, l in enumerate(components(mask, diagonal=True)):
        for o in objects(l):
            if low <= measures(o)[measure] <= high:
                out[r, o[:, 0], o[:, 1]] = x[r, o[:, 0], o[:, 1]] if edges is None else 255.0
    return out


_INF = float("inf")


def _contour(name: str, measure: str, kind: str, default: float, edges=True) -> None:
    if kind == "range":
        register(Op(name, 1, {"low": 0.0, "high": default}, kernel=lambda x, low=0.0, high=default: keep_contours(x, measure, low, high, edges), image=True, doc=f"outlines with {measure} within bounds"))
    else:
        register(Op(name, 1, {"bound": default}, kernel=lambda x, bound=default: keep_contours(x, measure, bound if kind == "min" else -_INF, _INF if kind == "min" else bound, edges), image=True, doc=f"outlines with {measure} at {'least' if kind == 'min' else 'most'} a bound"))


for _m, _a, _b in (("Area", "area", 10.0), ("Length", "length", 10.0), ("EnclosingCircle", "circle", 10.0), ("ExtentEnclosingCircle", "circle_extent", 0.5), ("AspectRatio", "aspect", 0.5), ("Extent", "extent", 0.5), ("Solidity", "solidity", 0.5), ("EquDiameter", "diameter", 2.0)):
    for _k in ("min", "max", "range"):
        if (_m, _k) not in {("Area", "range")}:
            _contour(f"ContourMask{_k.capitalize()}{_m}", _a, _k, _b)
_contour("ContoursMinArea", "area", "min", 10.0)
_contour("ContoursMaxArea", "area", "max", 10.0)
_contour("ContoursMinLength", "length", "min", 10.0)
_contour("ContoursMaxLength", "length", "max", 10.0, edges=False)
_contour("ContourMask", "area", "min", 0.0)


@image("ContoursConvexConcave", "outlines that are convex, or those that are not", convex=True)
def convex_contours(x, convex=True):
    return keep_contours(x, "convex", *((1, 1) if convex else (0, 0)))


register(Op("ContourMaskConvex", 1, {"convex": True}, kernel=convex_contours, image=True, doc="as ContoursConvexConcave"))

# --- templates and blobs ---------------------------------------------------------------------------------------------


@image("MatchedFiltering2D", "correlation with a Gaussian kernel, edges repeated", size=3, std=1.0)
def matched_2d(x, size=3, std=1.0):
    g = gauss(odd(size), std)
    return correlate(x, np.outer(g, g), "edge")


def target_chips(x: np.ndarray, size: int, points: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(image, chip): the neighbourhoods of every target point (row, column) in its image, or where no points are given
    of every image's brightest pixel. Points outside their image are none."""
    w = windows(x, size, size, "edge")
    if points is None:
        pixels = x.shape[1] * x.shape[2]
        flat = w.reshape(len(x), pixels, size * size)
        return np.arange(len(x)), flat[np.arange(len(x)), x.reshape(len(x), pixels).argmax(axis=1)]
    at = [(i, int(round(r)), int(round(c))) for i, row in enumerate(points) for r, c in (row if row is not None else ()) if 0 <= round(r) < x.shape[1] and 0 <= round(c) < x.shape[2]]
    i, r, c = np.array(at, int).reshape(-1, 3).T
    return i, w[i, r, c].reshape(len(i), size * size)


def chip_sums(x, points=None, size=3, r=None, **_):
    """Per image the sum of its target chips, and their number."""
    size = odd(size) if r is None else 2 * int(r) + 1
    i, chips = target_chips(x, size, points)
    out = np.zeros((len(x), size * size + 1))
    np.add.at(out, i, np.column_stack([chips, np.ones(len(i))]))
    return out


def pixel_sums(x, points=None, r=1):
    """Per image the sum, the sum of squares and the number of the pixels around its targets."""
    i, chips = target_chips(x, 2 * int(r) + 1, points)
    out = np.zeros((len(x), 3))
    np.add.at(out, i, np.column_stack([chips.sum(axis=1), (chips**2).sum(axis=1), np.full(len(i), chips.shape[1])]))
    return out


def mean_chip(fitted: np.ndarray) -> np.ndarray:
    """The mean of all target chips: a template from the data."""
    k = math.isqrt(len(fitted) - 1)
    return (fitted[:-1] / max(fitted[-1], 1)).reshape(k, k)


@image("ConvolveChannelMerge", "convolution with the mean target chip", fit=chip_sums, size=3)
def convolve_merge(x, size=3, fitted=None):
    k = mean_chip(fitted)
    return correlate(x - x.mean(axis=(1, 2), keepdims=True), k[::-1, ::-1], "constant")


@image("Cv2TemplateMatching", "match with the mean target chip; squared difference, correlation or coefficient, plain or normed, by index % 6", fit=chip_sums, size=3, method=5)
def template_matching(x, size=3, method=5, fitted=None):
    k = mean_chip(fitted)
    w = np.lib.stride_tricks.sliding_window_view(x, k.shape, axis=(1, 2))
    m, norm = int(method) % 6 // 2, int(method) % 2
    if m == 2:
        w, k = w - w.mean(axis=(3, 4), keepdims=True), k - k.mean()
    out = ((w - k) ** 2).sum(axis=(3, 4)) if m == 0 else (w * k).sum(axis=(3, 4))
    return out / np.maximum(np.sqrt((w**2).sum(axis=(3, 4)) * (k**2).sum()), 1e-12) if norm else out


@image("ObjectDetection", "places (y, x) above a noise level whose scaled patch agrees with a Gaussian", threshold=1.5, agree=1.0)
def object_detection(x, threshold=1.5, agree=1.0):
    g = np.outer(gauss(3, 1.0), gauss(3, 1.0))
    w = windows(x, 3, 3, "edge")
    z = (w - w.mean(axis=(3, 4), keepdims=True)) / np.maximum(w.std(axis=(3, 4), keepdims=True), 1e-12)
    level = np.median(x, axis=(1, 2), keepdims=True) + threshold * x.std(axis=(1, 2), keepdims=True)
    hit = (x > level) & (x == w.max(axis=(3, 4))) & ((z * (g - g.mean())).sum(axis=(3, 4)) * 9 >= agree)
    return ragged([np.argwhere(h) for h in hit])


@image("SEPObjectDetection", "centres (row, column) of bright objects with enough flux", threshold=1.0, flux=0.0)
def sep_detection(x, threshold=1.0, flux=0.0):
    base = x - np.median(x, axis=(1, 2), keepdims=True)
    mask = base > threshold * x.std(axis=(1, 2), keepdims=True)
    out = []
    for l, v in zip(components(mask), base):
        row = []
        for o in objects(l):
            m = v[o[:, 0], o[:, 1]]
            if m.sum() >= flux:
                row.append((o * m[:, None]).sum(axis=0) / m.sum())
        out.append(row)
    return ragged(out)


def _blobs(stack: np.ndarray, sigmas: np.ndarray, threshold: float, overlap: float) -> list[np.ndarray]:
    """Maxima over place and scale, weaker ones that overlap a stronger one left out: (row, column, sigma)."""
    out = []
    p = np.pad(stack, ((0, 0), (1, 1), (1, 1), (1, 1)), constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(p, (3, 3, 3), axis=(1, 2, 3)).max(axis=(4, 5, 6))
    for r in range(len(stack)):
        found = sorted(((stack[r, s, i, j], i, j, sigmas[s]) for s, i, j in np.argwhere((stack[r] == top[r]) & (stack[r] > threshold))), reverse=True)
        kept: list = []
        for _, i, j, s in found:
            if all(math.hypot(i - a, j - b) > (1 - overlap) * math.sqrt(2) * (s + t) for a, b, t in kept):
                kept.append((i, j, s))
        out.append(kept)
    return ragged(out)


@image("LogDetection", "blobs by the Laplacian of Gaussians", low=1.0, high=3.0, num=4, threshold=0.05, overlap=0.5)
def log_blobs(x, low=1.0, high=3.0, num=4, threshold=0.05, overlap=0.5):
    sig = np.linspace(low, high, max(1, int(num)))
    lap = [-(s**2) * (sobel_xy(b := blur(x, s), 2, 0, 3) / 4 + sobel_xy(b, 0, 2, 3) / 4) for s in sig]
    return _blobs(np.stack(lap, axis=1), sig, threshold, overlap)


@image("DogDetection", "blobs by differences of Gaussians", low=1.0, high=3.0, ratio=1.6, threshold=0.05, overlap=0.5)
def dog_blobs(x, low=1.0, high=3.0, ratio=1.6, threshold=0.05, overlap=0.5):
    sig = low * ratio ** np.arange(max(1, int(math.log(high / low, ratio)) + 1) + 1)
    g = [blur(x, s) for s in sig]
    return _blobs(np.stack([(a - b) / (ratio - 1) for a, b in zip(g, g[1:])], axis=1), sig[:-1], threshold, overlap)


@image("DohDetection", "blobs by the determinant of the Hessian", low=1.0, high=3.0, num=4, threshold=0.001, overlap=0.5)
def doh_blobs(x, low=1.0, high=3.0, num=4, threshold=0.001, overlap=0.5):
    sig = np.linspace(low, high, max(1, int(num)))
    det = []
    for s in sig:
        b = blur(x, s)
        det.append(s**4 * (sobel_xy(b, 2, 0) * sobel_xy(b, 0, 2) / 16 - (sobel_xy(b, 1, 1) / 4) ** 2))
    return _blobs(np.stack(det, axis=1), sig, threshold, overlap)


@image("RXAnomalyDetector", "1 where a pixel's neighbourhood is far from the image's mean in its covariance", quantile=0.99)
def rx(x, quantile=0.99):
    v = np.stack([x, np.roll(x, 1, 1), np.roll(x, 1, 2)], axis=3).reshape(len(x), -1, 3)
    d = v - v.mean(axis=1, keepdims=True)
    cov = np.einsum("rni,rnj->rij", d, d) / max(v.shape[1] - 1, 1) + 1e-9 * np.eye(3)
    m = np.einsum("rni,rij,rnj->rn", d, np.linalg.inv(cov), d)
    # Wilson-Hilferty: quantile of chi square with three degrees of freedom
    from statistics import NormalDist

    limit = 3 * (1 - 2 / 27 + NormalDist().inv_cdf(quantile) * math.sqrt(2 / 27)) ** 3
    return (m > limit).astype(float).reshape(x.shape)


@image("NormalLikelihood", "density of each pixel under the normal fitted to the pixels around all targets", fit=pixel_sums, r=1)
def normal_likelihood(x, r=1, fitted=None):
    total, squares, n = fitted
    mean = total / max(n, 1)
    std = math.sqrt(max(squares / max(n, 1) - mean * mean, 0)) + 1e-9 if n else 1.0
    return np.exp(-0.5 * ((x - mean) / std) ** 2) / (std * math.sqrt(2 * math.pi))


@image("SepDetectionWindow", "windows around detected objects, one after the other", r=1, threshold=1.0)
def sep_windows(x, r=1, threshold=1.0):
    w = windows(x, 2 * int(r) + 1, 2 * int(r) + 1, "edge")
    return ragged([[w[i, int(round(a)), int(round(b))] for a, b in c.reshape(-1, 2)] for i, c in enumerate(sep_detection(x, threshold))])


@image("MaximumWindow", "windows around local maxima at or above a threshold", r=1, size=3, threshold=1.0)
def maximum_windows(x, r=1, size=3, threshold=1.0):
    top = windows(x, odd(size), odd(size), "symmetric").max(axis=(3, 4))
    w = windows(x, 2 * int(r) + 1, 2 * int(r) + 1, "edge")
    return ragged([[w[i, int(o.mean(axis=0)[0]), int(o.mean(axis=0)[1])] for o in objects(l)] for i, l in enumerate(components((x == top) & (x >= threshold)))])


@image("CCorrObjectFilter", "local maxima whose window agrees with the mean chip: (row, column)", fit=chip_sums, r=1, threshold=0.1)
def ccorr_filter(x, r=1, threshold=0.1, fitted=None):
    k = 2 * int(r) + 1
    chip = mean_chip(fitted)
    chip = chip / (chip.sum() or 1.0)
    w = windows(x, k, k, "edge")
    s = w.sum(axis=(3, 4), keepdims=True)
    agree = (w / np.where(s == 0, 1, s) * chip).sum(axis=(3, 4))
    return ragged([np.argwhere(h) for h in (x == w.max(axis=(3, 4))) & (agree >= threshold)])


@image("CreateBBox", "windows around the places in the second input", inputs=2, r=1)
def create_bbox(x, y, r=1):
    h, w = x.shape[1:]
    win = windows(x, 2 * int(r) + 1, 2 * int(r) + 1, "edge")
    at = np.abs(y.reshape(len(y), -1)[:, :2]).astype(int) % np.array([h, w])
    return win[np.arange(len(x)), at[:, 0], at[:, 1]].reshape(len(x), -1)


# --- descriptors and textures ----------------------------------------------------------------------------------------


@image("Hog", "histograms of gradient directions per cell, normed over blocks", orientations=8, cell=4, block=2)
def hog(x, orientations=8, cell=4, block=2):
    gy, gx = np.gradient(x, axis=1), np.gradient(x, axis=2)
    mag, way = np.hypot(gx, gy), np.floor((np.arctan2(gy, gx) % math.pi) / math.pi * orientations).astype(int) % orientations
    ch, cw = x.shape[1] // cell, x.shape[2] // cell
    h = np.zeros((len(x), ch, cw, orientations))
    for o in range(orientations):
        part = np.where(way == o, mag, 0)[:, : ch * cell, : cw * cell].reshape(len(x), ch, cell, cw, cell)
        h[..., o] = part.sum(axis=(2, 4)) / cell**2
    b = min(block, ch, cw)
    out = [v / np.sqrt((v**2).sum(axis=1, keepdims=True) + 1e-10) for i in range(ch - b + 1) for j in range(cw - b + 1) for v in [h[:, i : i + b, j : j + b].reshape(len(x), -1)]]
    return np.concatenate(out, axis=1) if out else np.zeros((len(x), 0))


@image("Daisy", "blurred direction maps sampled on rings around a grid of places", step=4, radius=2, rings=2, histograms=4, orientations=4)
def daisy(x, step=4, radius=2, rings=2, histograms=4, orientations=4):
    gy, gx = np.gradient(x, axis=1), np.gradient(x, axis=2)
    maps = [np.maximum(gx * math.cos(2 * math.pi * o / orientations) + gy * math.sin(2 * math.pi * o / orientations), 0) for o in range(orientations)]
    out = []
    smooth = [[blur(m, radius * (k + 1) / (2 * rings)) for m in maps] for k in range(rings)]
    for i in range(radius, x.shape[1] - radius, step):
        for j in range(radius, x.shape[2] - radius, step):
            parts = [m[:, i, j] for m in smooth[0]]
            for k in range(rings):
                for a in range(histograms):
                    t, d = 2 * math.pi * a / histograms, radius * (k + 1) / rings
                    parts += [m[:, int(round(i + d * math.sin(t))), int(round(j + d * math.cos(t)))] for m in smooth[k]]
            v = np.stack(parts, axis=1)
            out.append(v / np.maximum(v.sum(axis=1, keepdims=True), 1e-12))
    return np.concatenate(out, axis=1) if out else np.zeros((len(x), 0))


def _glcm(x, levels=8):
    lo, hi = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
    b = np.clip(((x - lo) / np.where(hi > lo, hi - lo, 1) * levels).astype(int), 0, levels - 1)
    pair = (b[:, :, :-1] * levels + b[:, :, 1:]).reshape(len(x), -1)
    g = np.stack([np.bincount(p, minlength=levels**2) for p in pair]).reshape(-1, levels, levels).astype(float) if len(x) else np.zeros((0, levels, levels))
    g = g + g.transpose(0, 2, 1)
    g /= np.maximum(g.sum(axis=(1, 2), keepdims=True), 1)
    i, j = np.meshgrid(np.arange(levels), np.arange(levels), indexing="ij")
    mi, mj = (g * i).sum(axis=(1, 2), keepdims=True), (g * j).sum(axis=(1, 2), keepdims=True)
    si, sj = np.sqrt((g * (i - mi) ** 2).sum(axis=(1, 2))), np.sqrt((g * (j - mj) ** 2).sum(axis=(1, 2)))
    asm = (g**2).sum(axis=(1, 2))
    corr = (g * (i - mi) * (j - mj)).sum(axis=(1, 2)) / np.where(si * sj > 0, si * sj, 1)
    return np.stack([(g * (i - j) ** 2).sum(axis=(1, 2)), (g * np.abs(i - j)).sum(axis=(1, 2)), (g / (1 + (i - j) ** 2)).sum(axis=(1, 2)), asm, np.sqrt(asm), corr], axis=1)


@image("glcm_feature", "contrast, dissimilarity, homogeneity, second moment, energy, correlation of neighbour levels")
def glcm(x):
    return _glcm(x)


@image("glcm_patches_feature", "glcm_feature of each patch", patch=4)
def glcm_patches(x, patch=4):
    return np.concatenate([_glcm(x[:, i : i + patch, j : j + patch]) for i in range(0, x.shape[1], patch) for j in range(0, x.shape[2], patch)], axis=1)
