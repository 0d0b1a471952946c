"""SQL for kernels on images of 8 by 8, written as sums and order statistics over lists of neighbours.

The kernels pad arrays, slide windows and go through Fourier transforms; the SQL here never does. It names each
neighbour by its offset, folds its place back into the image by the border rule, and states frequency filters as
circular sums, so that the two agree only if both are right.
"""

from __future__ import annotations

import math

SIDE = 8
_BYTES = "list_transform(embedding, lambda v: CAST(CAST(floor(abs(CAST(v AS DOUBLE)) * 997) AS BIGINT) % 256 AS DOUBLE))"
_FLOATS = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def num(v: float) -> str:
    return f"({float(v)!r}::DOUBLE)"


def folded(at: str, border: str) -> str:
    """A row or column that may lie outside, brought back by a border rule."""
    last = SIDE - 1
    if border == "edge":
        return f"greatest(0, least({last}, {at}))"
    if border == "reflect":
        return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > {last} THEN {2 * last} - ({at}) ELSE {at} END"
    if border == "symmetric":
        return f"CASE WHEN {at} < 0 THEN -({at}) - 1 WHEN {at} > {last} THEN {2 * last + 1} - ({at}) ELSE {at} END"
    return at


def near(x: str, offsets: list[tuple[int, int, float]], border: str, weighted: bool = False) -> str:
    """Values (or weighted values) of the neighbours of pixel k at offsets (row, column, weight)."""
    o = "[" + ", ".join(f"{{'y': {y}, 'x': {c}, 'w': {num(w)}}}" for y, c, w in offsets) + "]"
    value = f"{x}[({folded('(k // 8 + o.y)', border)}) * 8 + ({folded('(k % 8 + o.x)', border)}) + 1]"
    if border == "zero":
        value = f"CASE WHEN k // 8 + o.y BETWEEN 0 AND 7 AND k % 8 + o.x BETWEEN 0 AND 7 THEN {x}[(k // 8 + o.y) * 8 + k % 8 + o.x + 1] ELSE 0 END"
    return f"list_transform({o}, lambda o: {'o.w * ' if weighted else ''}{value})"


def pixels(f: str) -> str:
    return f"list_transform(range(0, 64), lambda k: {f})"


def square(k: int, j: int | None = None) -> list[tuple[int, int, float]]:
    j = k if j is None else j
    return [(y, x, 1.0) for y in range(-(k // 2), k // 2 + 1) for x in range(-(j // 2), j // 2 + 1)]


def disk(r: int) -> list[tuple[int, int, float]]:
    return [o for o in square(2 * r + 1) if o[0] ** 2 + o[1] ** 2 <= r * r]


def hole(k: int, h: int) -> list[tuple[int, int, float]]:
    return [o for o in square(k) if max(abs(o[0]), abs(o[1])) > h // 2]


def weighted(taps_y: list[float], taps_x: list[float]) -> list[tuple[int, int, float]]:
    return [(y - len(taps_y) // 2, x - len(taps_x) // 2, a * b) for y, a in enumerate(taps_y) for x, b in enumerate(taps_x)]


def bell(size: int, sigma: float) -> list[float]:
    w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [v / sum(w) for v in w]


def filtered(x: str, offsets, border: str) -> str:
    return pixels(f"list_sum({near(x, offsets, border, True)})")


def query(*columns: tuple[str, str], floats: bool = False, places: int = 6) -> str:
    """Columns built one on the other from the image ``x``; the last is the result. ``y`` is the image reversed."""
    x = _FLOATS if floats else _BYTES
    t = f"SELECT vec_id, x, list_reverse(x) AS y, list_concat(x[2:], x[1:1]) AS z FROM (SELECT vec_id, {x} AS x FROM embeddings)"
    for name, text in columns:
        t = f"SELECT *, {text} AS {name} FROM ({t})"
    return f"""SELECT vec_id, CAST(p - 1 AS INT) AS pos, round(CAST({columns[-1][0]}[p] AS DOUBLE), {places}) AS val FROM ({t}), LATERAL (SELECT unnest(range(1, len({columns[-1][0]}) + 1)) AS p)"""


# Derivatives in one direction smoothed in the other: each tap pair by hand for the sizes used here.
D1, S3, D2 = [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0], [1.0, -2.0, 1.0]
D1_5 = [-1.0, -2.0, 0.0, 2.0, 1.0]
GX, GY = ("gx", filtered("x", weighted(S3, D1), "reflect")), ("gy", filtered("x", weighted(D1, S3), "reflect"))
_MEAN5 = ("m", pixels(f"list_avg({near('x', square(5), 'reflect')})"))


def _box(x: str, k: int) -> str:
    return pixels(f"list_avg({near(x, square(k), 'reflect')})")


def _product(a: str, b: str) -> str:
    return f"list_transform(range(1, 65), lambda j: {a}[j] * {b}[j])"


_TENSOR = [GX, GY, ("xx", _product("gx", "gx")), ("xy", _product("gx", "gy")), ("yy", _product("gy", "gy")), ("a", _box("xx", 3)), ("b", _box("xy", 3)), ("c", _box("yy", 3))]


def _frequency(h: str) -> list[tuple[str, str]]:
    """A filter with response h(fy, fx), as a circular sum with its impulse response."""
    cycles = lambda u: f"(CASE WHEN {u} < 4 THEN {u} ELSE {u} - 8 END / 8.0)"
    response = h.replace("fy", cycles("(u // 8)")).replace("fx", cycles("(u % 8)"))
    impulse = f"list_transform(range(0, 64), lambda k: list_sum(list_transform(range(0, 64), lambda u: ({response}) * cos(2 * pi() * ((u // 8) * (k // 8) + (u % 8) * (k % 8)) / 8))) / 64)"
    return [("g", impulse), ("lo", pixels("abs(list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * g[((k // 8 - j // 8 + 8) % 8) * 8 + (k % 8 - j % 8 + 8) % 8 + 1])))"))]


_LESS = ("hi", "list_transform(range(1, 65), lambda j: x[j] - lo[j])")
_GAUSS_F = "exp(-2 * pow(pi() * 3, 2) * (fx * fx + fy * fy))"
_SINC = lambda f: f"CASE WHEN {f} = 0 THEN 1 ELSE sin(pi() * 3 * {f}) / (pi() * 3 * nullif({f}, 0)) END"
_UNIFORM_F = f"({_SINC('fx')}) * ({_SINC('fy')})"


def _dct(x: str, forward: bool) -> str:
    c = lambda k, i: f"(CASE WHEN {k} = 0 THEN sqrt(1 / 8e0) ELSE sqrt(2 / 8e0) END * cos(pi() * (2 * {i} + 1) * {k} / 16))"
    a, b = (c("(k // 8)", "(j // 8)"), c("(k % 8)", "(j % 8)")) if forward else (c("(j // 8)", "(k // 8)"), c("(j % 8)", "(k % 8)"))
    return pixels(f"list_sum(list_transform(range(0, 64), lambda j: {x}[j + 1] * {a} * {b}))")


_TOP = "list_position(x, list_max(x)) - 1"
#: The template: the mean over all images of what stands around the brightest pixel.
_CHIP = [
    ("t", f"list_transform([{', '.join(str(i) for i in range(9))}], lambda o: x[greatest(0, least(7, ({_TOP}) // 8 + o // 3 - 1)) * 8 + greatest(0, least(7, ({_TOP}) % 8 + o % 3 - 1)) + 1])"),
    ("chip", "[" + ", ".join(f"avg(t[{i}]) OVER ()" for i in range(1, 10)) + "]"),
]
_AROUND = square(3)
SQL = {
    "op_GradientMagnitude": query(GX, GY, ("r", pixels("sqrt(gx[k + 1] * gx[k + 1] + gy[k + 1] * gy[k + 1])"))),
    "op_GradientWeighted": query(GX, GY, ("r", pixels("0.5 * abs(gx[k + 1]) + 0.5 * abs(gy[k + 1])"))),
    "op_SobelFilter": query(("sx", filtered("x", weighted(S3, D1), "symmetric")), ("sy", filtered("x", weighted(D1, S3), "symmetric")), ("r", pixels("sqrt((pow(sx[k + 1] / 4, 2) + pow(sy[k + 1] / 4, 2)) / 2)"))),
    "op_HighpassSobelDerivative": query(("r", filtered("x", weighted(D1_5, D1_5), "reflect"))),
    "op_HighpassLaplacian": query(("r", filtered("x", [(y, c, D2[c + 1] * S3[y + 1] + S3[c + 1] * D2[y + 1]) for y, c, _ in square(3)], "reflect"))),
    "op_HighpassIrst": query(("r", filtered("x", [(0, 0, 5.0), (0, 1, -1.0), (0, -1, -1.0), (1, 0, -1.0), (-1, 0, -1.0)], "reflect"))),
    "op_HighpassUnsharpMask": query(("g", filtered("x", weighted(bell(9, 10.0), bell(9, 10.0)), "reflect")), ("r", pixels("1.5 * x[k + 1] - 0.5 * g[k + 1]"))),
    "op_LowpassFilterAverage": query(_MEAN5),
    "op_LowpassFilterGaussian": query(("r", filtered("x", weighted(bell(3, 0.5), bell(3, 0.5)), "reflect"))),
    "op_GaussianFilter": query(("r", filtered("x", weighted(bell(9, 1.0), bell(9, 1.0)), "edge"))),
    "op_LowpassFilterMedian": query(("r", pixels(f"list_median({near('x', square(5), 'edge')})"))),
    "op_MedianFilter": query(("r", pixels(f"list_median({near('x', square(3), 'zero')})"))),
    "op_SkiMedianFilter": query(("r", pixels(f"list_median({near('x', disk(3), 'symmetric')})"))),
    "op_MeanFilter": query(("r", pixels(f"list_avg({near('x', disk(3), 'symmetric')})"))),
    "op_EqualizeDisk": query(("r", pixels(f"list_avg(list_transform({near('x', disk(3), 'symmetric')}, lambda v: CASE WHEN v <= x[k + 1] THEN 255e0 ELSE 0e0 END))"))),
    "op_LowpassFilterBilateral": query(
        ("r", pixels(f"list_sum(list_transform(list_zip({near('x', disk(4), 'reflect')}, [{', '.join(num(math.exp(-(y * y + c * c) / (2.0 * 75**2))) for y, c, _ in disk(4))}]), lambda p: p[1] * p[2] * exp(-pow(p[1] - x[k + 1], 2) / 11250e0)))"
                     f" / list_sum(list_transform(list_zip({near('x', disk(4), 'reflect')}, [{', '.join(num(math.exp(-(y * y + c * c) / (2.0 * 75**2))) for y, c, _ in disk(4))}]), lambda p: p[2] * exp(-pow(p[1] - x[k + 1], 2) / 11250e0)))")),
    ),
    "op_HighpassFourierGaussian": query(*_frequency(_GAUSS_F), _LESS),
    "op_LowpassFourierGaussian": query(*_frequency(_GAUSS_F)),
    "op_HighpassFourierUniform": query(*_frequency(_UNIFORM_F), _LESS),
    "op_LowpassFilterUniform": query(*_frequency(_UNIFORM_F)),
    "op_Cv2RMS": query(("r", pixels("sqrt(greatest(list_avg(list_transform(@, lambda v: v * v)) - pow(list_avg(@), 2), 0))".replace("@", near("x", square(5), "reflect"))))),
    "op_StdDeviation": query(_MEAN5, ("r", pixels("abs(x[k + 1] - m[k + 1]) / 5"))),
    "op_AdaptiveThresholdMeanMask": query(("r", pixels(f"CASE WHEN x[k + 1] > list_avg({near('x', square(11), 'edge')}) - 2 THEN 255 ELSE 0 END"))),
    "op_AdaptiveThresholdGaussianMask": query(("g", filtered("x", weighted(bell(11, 2.0), bell(11, 2.0)), "edge")), ("r", pixels("CASE WHEN x[k + 1] > g[k + 1] - 2 THEN 255 ELSE 0 END"))),
    "op_MedianFilterHole": query(("r", pixels(f"list_median({near('x', hole(7, 3), 'symmetric')})"))),
    "op_StdDeviationHole": query(("r", pixels(f"list_stddev_pop({near('x', hole(7, 3), 'symmetric')})"))),
    "op_MeanWithHole": query(("r", pixels(f"list_sum({near('x', hole(7, 3), 'reflect')}) / 49"))),
    "op_rmsHole": query(("r", pixels(f"list_stddev_pop({near('x', hole(7, 3), 'reflect')})"))),
    "op_Prerejection": query(("r", pixels(f"CASE WHEN x[k + 1] > list_stddev_pop({near('x', hole(7, 3), 'symmetric')}) THEN 0 ELSE x[k + 1] END"))),
    "op_CornerDetectionHarris": query(*_TENSOR, ("r", pixels("a[k + 1] * c[k + 1] - b[k + 1] * b[k + 1] - 0.04 * pow(a[k + 1] + c[k + 1], 2)"))),
    "op_CornerDetectionEigen": query(*_TENSOR, ("r", pixels("(a[k + 1] + c[k + 1]) / 2 - sqrt(pow((a[k + 1] - c[k + 1]) / 2, 2) + b[k + 1] * b[k + 1])"))),
    "op_MaximumFilter": query(("r", pixels("CASE WHEN x[k + 1] = list_max(@) AND list_max(@) - list_min(@) > 27 THEN 1 ELSE 0 END".replace("@", near("x", square(3), "symmetric"))))),
    "op_MatchedFiltering2D": query(("r", filtered("x", weighted(bell(3, 1.0), bell(3, 1.0)), "edge"))),
    "op_Cv2DCT": query(("r", _dct("x", True))),
    "op_Cv2iDCT": query(("r", _dct("x", False))),
    "op_Cv2iDFT": query(("r", pixels("list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * cos(2 * pi() * ((k // 8) * (j // 8) + (k % 8) * (j % 8)) / 8)))"))),
    "op_MultiplySpectrum": query(("r", pixels("list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * y[((k // 8 - j // 8 + 8) % 8) * 8 + (k % 8 - j % 8 + 8) % 8 + 1]))"))),
    "op_Correlation": query(("r", pixels("list_sum(list_transform(range(0, 64), lambda j: CASE WHEN k // 8 + j // 8 - 4 BETWEEN 0 AND 7 AND k % 8 + j % 8 - 4 BETWEEN 0 AND 7 THEN x[(k // 8 + j // 8 - 4) * 8 + k % 8 + j % 8 - 4 + 1] * y[j + 1] ELSE 0 END))"))),
    "op_SpectralFilter": query(("u", "list_concat(y[2:], y[1:1])"), ("w", "list_sum(list_transform(range(1, 65), lambda j: z[j] * u[j])) / greatest(list_sum(list_transform(u, lambda v: v * v)), 1e-12)"), ("r", "list_transform(range(1, 65), lambda j: x[j] - w * y[j])")),
    "op_CreateBBox": query(("r", "list_transform(range(0, 9), lambda o: x[greatest(0, least(7, CAST(trunc(abs(y[1])) AS INT) % 8 + o // 3 - 1)) * 8 + greatest(0, least(7, CAST(trunc(abs(y[2])) AS INT) % 8 + o % 3 - 1)) + 1])")),
    "op_ConvolveChannelMerge": query(*_CHIP, ("d", "list_transform(x, lambda v: v - list_avg(x))"), ("r", pixels(f"list_sum(list_transform(range(0, 9), lambda o: chip[9 - o] * ({near('d', _AROUND, 'zero')})[o + 1]))")), places=8),
    "op_Cv2TemplateMatching": query(
        *_CHIP,
        ("c", "list_transform(chip, lambda v: v - list_avg(chip))"),
        ("win", f"list_transform(range(0, 36), lambda p: list_transform(range(0, 9), lambda o: x[(p // 6 + o // 3) * 8 + p % 6 + o % 3 + 1]))"),
        ("r", "list_transform(win, lambda w: list_sum(list_transform(range(1, 10), lambda o: (w[o] - list_avg(w)) * c[o])) / greatest(sqrt(list_sum(list_transform(w, lambda v: pow(v - list_avg(w), 2))) * list_sum(list_transform(c, lambda v: v * v))), 1e-12))"),
    ),
    "op_NormalLikelihood": query(
        _CHIP[0],
        ("mean", "avg(list_avg(t)) OVER ()"),
        ("dev", "sqrt(avg(list_avg(list_transform(t, lambda v: v * v))) OVER () - pow(avg(list_avg(t)) OVER (), 2)) + 1e-9"),
        ("r", pixels("exp(-0.5 * pow((x[k + 1] - mean) / dev, 2)) / (dev * sqrt(2 * pi()))")),
    ),
    "op_CCorrObjectFilter": query(
        *_CHIP,
        ("c", "list_transform(chip, lambda v: v / list_sum(chip))"),
        ("hit", f"list_filter(range(0, 64), lambda k: x[k + 1] = list_max({near('x', _AROUND, 'edge')}) AND list_sum(list_transform(range(1, 10), lambda o: ({near('x', _AROUND, 'edge')})[o] * c[o])) / CASE WHEN list_sum({near('x', _AROUND, 'edge')}) = 0 THEN 1 ELSE list_sum({near('x', _AROUND, 'edge')}) END >= 0.1)"),
        ("r", "flatten(list_transform(hit, lambda k: [k // 8, k % 8]))"),
    ),
    "op_AccumulateWeighted": query(
        ("r", "list_transform(range(8, 64), lambda k: pow(0.99::DOUBLE, k // 8) * x[k % 8 + 1] + list_sum(list_transform(range(1, k // 8 + 1), lambda t: 0.01::DOUBLE * pow(0.99::DOUBLE, k // 8 - t) * x[t * 8 + k % 8 + 1])))"),
        floats=True,
    ),
}
