"""SQL for kernels on rows of 64 samples, and for histograms and windows of images of 8 by 8."""

from __future__ import annotations

from arbora.queries.contour_sql import _CENTRES, _IMAGES, _STARS, _labelled
from arbora.queries.image_sql import bell, near, num, pixels, query, square


def _kalman_weights() -> tuple[str, str]:
    """Gains do not depend on the samples: each estimate is a fixed weighting of all samples so far."""
    keep, q, r, p, gains = 1.0, 1e-5, 0.01, 1.0, [1.0]
    for _ in range(63):
        p += q
        gains.append(p / (p + r))
        p *= 1 - gains[-1]
    left = []
    for g in gains[1:]:
        keep *= 1 - g
        left.append(keep)
    return "[" + ", ".join(num(g) for g in gains) + "]", "[" + ", ".join(num(v) for v in [1.0, *left]) + "]"


_GAINS, _LEFT = _kalman_weights()
_I0 = "list_sum(list_transform(range(0, 40), lambda m: exp(2 * m * ln(greatest({}, 1e-300) / 2) - 2 * lgamma(m + 1))))"
_PLANCK = "CASE WHEN j = 0 THEN 0 WHEN j < 6.3 THEN 1 / (exp(6.3 / j - 6.3 / (6.3 - j)) + 1) ELSE 1 END"
#: Smoothing by a cubic over 11 samples: the published closed form of its weights.
_CUBIC = "3 * (3 * 25 + 3 * 5 - 1 - 5 * pow(o - 5, 2)) / (9 * 11 * 13e0)"
_PADDED = "list_concat(list_transform([6, 5, 4, 3, 2], lambda i: x[1] - abs(x[i] - x[1])), list_concat(x, list_transform([63, 62, 61, 60, 59], lambda i: x[64] + abs(x[i] - x[64]))))"
_SAVGOL = query(("pad", _PADDED), ("r", f"list_transform(range(0, 64), lambda k: list_sum(list_transform(range(0, 11), lambda o: pad[k + o + 1] * {_CUBIC})))"), floats=True)
_BINS = ("b", "list_transform(x, lambda v: least(255, CAST(floor((v - list_min(x)) / CASE WHEN list_max(x) > list_min(x) THEN list_max(x) - list_min(x) ELSE 1 END * 256) AS INT)))")
_J1 = "list_sum(list_transform(range(0, 40), lambda m: CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END * exp((2 * m) * ln({r} / 2) - lgamma(m + 1) - lgamma(m + 2))))"


def _ellipsoid() -> list[tuple[str, str]]:
    f = lambda u: f"(CASE WHEN {u} < 4 THEN {u} ELSE {u} - 8 END / 8.0)"
    r = f"(pi() * 3 * sqrt(pow({f('(u // 8)')}, 2) + pow({f('(u % 8)')}, 2)))"
    response = f"list_transform(range(0, 64), lambda u: CASE WHEN u = 0 THEN 1 ELSE {_J1.format(r=r)} END)"
    return [
        ("h", response),
        ("g", "list_transform(range(0, 64), lambda k: list_sum(list_transform(range(0, 64), lambda u: h[u + 1] * cos(2 * pi() * ((u // 8) * (k // 8) + (u % 8) * (k % 8)) / 8))) / 64)"),
        ("lo", pixels("abs(list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * g[((k // 8 - j // 8 + 8) % 8) * 8 + (k % 8 - j % 8 + 8) % 8 + 1])))")),
    ]


def _windows(start: str, rows: str) -> str:
    """The 3 by 3 windows around places (k, y, x) of each image, one after the other."""
    return f"""{start}, spots AS ({rows}) SELECT spots.vec_id, CAST(9 * k + o AS INT) AS pos, round(im.x[greatest(0, least(7, spots.y + o // 3 - 1)) * 8 + greatest(0, least(7, spots.x + o % 3 - 1)) + 1], 6) AS val
      FROM spots JOIN im ON im.vec_id = spots.vec_id, LATERAL (SELECT unnest(range(0, 9)) AS o)"""


_TOPS = f"""WITH RECURSIVE {_IMAGES}, br AS (SELECT vec_id, x, {pixels(f"x[k + 1] = list_max({near('x', square(3), 'symmetric')}) AND x[k + 1] >= 1")} AS mask FROM im), {_labelled('br', False)}"""
_BELL = bell(3, 1.0)
_FLAT = [a * b - sum(c * d for c in _BELL for d in _BELL) / 9 for a in _BELL for b in _BELL]
_AROUND = near("x", square(3), "edge")
SQL = {
    "op_KalmanFilter": query(("r", f"list_transform(range(1, 65), lambda t: {_LEFT}[t] * x[1] + coalesce(list_sum(list_transform(range(2, t + 1), lambda s: x[s] * {_GAINS}[s] * {_LEFT}[t] / {_LEFT}[s])), 0))"), floats=True),
    "op_WindowKaiser": query(("r", f"list_transform(x, lambda v, i: v * {_I0.format('(pi() * 3 * sqrt(greatest(1 - pow(2 * (i - 1) / 63e0 - 1, 2), 0)))')} / {_I0.format('(pi() * 3)')})"), floats=True),
    "op_WindowPlanckTaper": query(("r", f"list_transform(x, lambda v, i: v * {_PLANCK.replace('j', '(i - 1)')} * {_PLANCK.replace('j', '(64 - i)')})"), floats=True),
    "op_WienerFilter": query(
        ("m", "list_transform(range(1, 65), lambda i: (coalesce(x[i - 1], 0) * CASE WHEN i > 1 THEN 1 ELSE 0 END + x[i] + coalesce(x[i + 1], 0)) / 3)"),
        ("s", "list_transform(range(1, 65), lambda i: (pow(coalesce(x[i - 1], 0), 2) * CASE WHEN i > 1 THEN 1 ELSE 0 END + pow(x[i], 2) + pow(coalesce(x[i + 1], 0), 2)) / 3 - pow(m[i], 2))"),
        ("r", "list_transform(range(1, 65), lambda i: CASE WHEN s[i] < list_avg(s) THEN m[i] ELSE m[i] + (1 - list_avg(s) / s[i]) * (x[i] - m[i]) END)"),
        floats=True,
    ),
    "op_SavitzkyGolayFilter": _SAVGOL,
    "op_savitzky_golay": _SAVGOL,
    "op_EqualizeHist": query(_BINS, ("r", "list_transform(b, lambda v: len(list_filter(b, lambda u: u <= v)) / 64e0)")),
    "op_OtsuBinaryThreshold": query(
        _BINS,
        ("w", "list_transform(range(0, 256), lambda t: len(list_filter(b, lambda u: u <= t)))"),
        ("s", "list_transform(range(0, 256), lambda t: coalesce(list_sum(list_filter(b, lambda u: u <= t)), 0))"),
        ("g", "list_transform(range(1, 257), lambda t: CASE WHEN w[t] IN (0, 64) THEN 0 ELSE pow(CAST(s[256] AS DOUBLE) * w[t] / w[256] - s[t], 2) / (w[t] * (w[256] - w[t])) END)"),
        ("r", "list_transform(b, lambda v: CASE WHEN v > list_position(g, list_max(g)) - 1 THEN 0 ELSE 255 END)"),
    ),
    "op_LowpassFilterEllipsoid": query(*_ellipsoid()),
    "op_HighpassFourierEllipsoid": query(*_ellipsoid(), ("hi", "list_transform(range(1, 65), lambda j: x[j] - lo[j])")),
    "op_SepDetectionWindow": _windows(_STARS, f"SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY l) - 1 AS k, CAST(round_even(r, 0) AS INT) AS y, CAST(round_even(c, 0) AS INT) AS x FROM ({_CENTRES})"),
    "op_MaximumWindow": _windows(_TOPS, "SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY l) - 1 AS k, CAST(floor(avg(r)) AS INT) AS y, CAST(floor(avg(c)) AS INT) AS x FROM px GROUP BY vec_id, l"),
    "op_ObjectDetection": query(
        ("level", "list_median(x) + 1.5 * list_stddev_pop(x)"),
        ("win", pixels(_AROUND)),
        ("hit", f"list_filter(range(0, 64), lambda k: x[k + 1] > level AND x[k + 1] = list_max(win[k + 1]) AND list_sum(list_transform(win[k + 1], lambda v, i: (v - list_avg(win[k + 1])) / greatest(list_stddev_pop(win[k + 1]), 1e-12) * [{', '.join(num(v) for v in _FLAT)}][i])) * 9 >= 1)"),
        ("r", "flatten(list_transform(hit, lambda k: [k // 8, k % 8]))"),
    ),
    "op_Hog": query(
        ("gy", pixels("CASE k // 8 WHEN 0 THEN x[k + 9] - x[k + 1] WHEN 7 THEN x[k + 1] - x[k - 7] ELSE (x[k + 9] - x[k - 7]) / 2 END")),
        ("gx", pixels("CASE k % 8 WHEN 0 THEN x[k + 2] - x[k + 1] WHEN 7 THEN x[k + 1] - x[k] ELSE (x[k + 2] - x[k]) / 2 END")),
        ("way", pixels("CAST(floor((CASE WHEN atan2(gy[k + 1], gx[k + 1]) < 0 THEN atan2(gy[k + 1], gx[k + 1]) + pi() ELSE atan2(gy[k + 1], gx[k + 1]) END) / pi() * 8) AS INT) % 8")),
        ("h", "list_transform(range(0, 32), lambda q: coalesce(list_sum(list_transform(list_filter(range(0, 64), lambda k: (k // 8) // 4 * 2 + (k % 8) // 4 = q // 8 AND way[k + 1] = q % 8), lambda k: sqrt(pow(gx[k + 1], 2) + pow(gy[k + 1], 2)))), 0) / 16)"),
        ("r", "list_transform(h, lambda v: v / sqrt(list_sum(list_transform(h, lambda u: u * u)) + 1e-10))"),
    ),
}
