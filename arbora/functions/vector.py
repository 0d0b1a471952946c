"""Native operators on arrays: arithmetic, mathematics, windows, thresholds, norms, slices and reductions.

Each is written as the body of a lambda over ``v`` (value), ``i`` (index from 0) and ``n`` (length), or as an
expression over the whole array ``x``. Quantities of the whole array that a body needs are bound once per row.
Rows whose result is not finite are found by :func:`arbora.operators.dataset.finite`; nothing is dropped here. A NULL
array gives NULL, an empty array an empty array (reductions: NULL or zero, as the expression says).
"""

from __future__ import annotations

import math

import numpy as np

from arbora.functions.registry import Op, register

DBL_MAX = "1.7976931348623157e308D"


def _num(v) -> str:
    if isinstance(v, bool):
        return "1" if v else "0"
    return f"({float(v)!r}D)" if isinstance(v, float) else f"({int(v)}D)"


def _ansi(text: str) -> str:
    import re

    text = re.sub(r"\b(\d+(?:\.\d+)?(?:e[+-]?\d+)?)D\b", r"CAST(\1 AS DOUBLE)", text)
    return text.replace("rint(", "round_even0(").replace("array_min(", "list_min(").replace("array_max(", "list_max(").replace("size(", "len(")


def _body(text: str, params: dict) -> str:
    return text.format(**{k: _num(v) for k, v in params.items()})


#: Whole-array quantities: name -> (Spark, SQL check).
BOUND = {
    "lo": ("array_min(x)", "list_min(x)"),
    "hi": ("array_max(x)", "list_max(x)"),
    "mean": ("(aggregate(x, 0D, (a, w) -> a + w) / nullif(size(x), 0))", "list_avg(x)"),
    "std": ("sqrt(aggregate(x, named_struct('s', 0D, 'q', 0D, 'c', 0D), (a, w) -> named_struct('s', a.s + (w - a.s) / (a.c + 1D), 'q', a.q + (w - a.s) * (w - (a.s + (w - a.s) / (a.c + 1D))), 'c', a.c + 1D), a -> a.q / nullif(a.c, 0D)))", "list_stddev_pop(x)"),
    "gap": (
        "array_min(transform(sequence(1, greatest(size(array_distinct(x)) - 1, 1)), j -> sort_array(array_distinct(x))[j] - sort_array(array_distinct(x))[j - 1]))",
        "list_min(list_transform(range(2, len(list_distinct(x)) + 1), lambda j: list_sort(list_distinct(x))[j] - list_sort(list_distinct(x))[j - 1]))",
    ),
}


def each(name: str, body: str, bound: tuple = (), doc: str = "", ansi: str = "", inputs: int = 1, **params) -> None:
    """An elementwise operator. With two or three inputs the values are v, w and z."""

    def native(xs: list[str], p: dict) -> str:
        b = _body(body, p)
        if inputs == 1:
            if not bound and not _uses_n(b):
                return f"transform({xs[0]}, (v, i) -> {_vi(b, 'i', '')})"
            binds = ", ".join(f"'{k}', {BOUND[k][0].replace('(x', '(b.x')}" for k in bound)
            inner = f"transform(array(named_struct('x', {xs[0]})), b -> named_struct('x', b.x, 'n', CAST(size(b.x) AS DOUBLE){', ' + binds if binds else ''}))"
            return f"element_at(transform({inner}, s -> transform(s.x, (v, i) -> {_vi(b, 'i', 's.')})), 1)"
        zipped = f"zip_with({xs[0]}, {xs[1]}, (v, w) -> {b})"
        if inputs == 3:
            zipped = f"zip_with(zip_with({xs[0]}, {xs[1]}, (v, w) -> named_struct('v', v, 'w', w)), {xs[2]}, (t, z) -> {_sub3(b)})"
        return zipped

    def check(xs: list[str], p: dict) -> str:
        b = _ansi(_body(ansi or body, p))
        b = _round_even(b)
        if inputs == 1:
            binds = ", ".join(f"'{k}': {BOUND[k][1].replace('x', xs[0])}" for k in bound)
            s = f"{{'x': {xs[0]}, 'n': CAST(len({xs[0]}) AS DOUBLE){', ' + binds if binds else ''}}}"
            return f"list_transform([{s}], lambda s: list_transform(s.x, lambda v, i: {_vi(b, '(i - 1)', 's.')}))[1]"
        j = {"v": f"{xs[0]}[j]", "w": f"{xs[1]}[j]"} | ({"z": f"{xs[2]}[j]"} if inputs == 3 else {})
        return f"list_transform(range(1, len({xs[0]}) + 1), lambda j: {_names(b, j)})"

    register(Op(name, inputs, params, native, check, doc=doc or body))


def _names(text: str, to: dict) -> str:
    import re

    return re.sub(r"(?<![A-Za-z0-9_.'])([a-z]+)(?![A-Za-z0-9_(.'])", lambda m: to.get(m[1], m[1]), text)


def _uses_n(b: str) -> bool:
    return _names(b, {"n": "§"}) != b


def _vi(b: str, i: str, at: str) -> str:
    return _names(b, {"i": f"CAST({i} AS DOUBLE)", "n": f"{at}n", **{k: f"{at}{k}" for k in BOUND}})


def _sub3(b: str) -> str:
    return _names(b, {"v": "t.v", "w": "t.w"})


def _round_even(b: str) -> str:
    while (at := b.find("round_even0(")) >= 0:
        deep, j = 1, at + len("round_even0(")
        while deep:
            deep += {"(": 1, ")": -1}.get(b[j], 0)
            j += 1
        b = b[:at] + "round_even(" + b[at + len("round_even0(") : j - 1] + ", 0)" + b[j:]
    return b


def whole(name: str, spark: str, sql: str, doc: str = "", inputs: int = 1, **params) -> None:
    """An operator that is one expression over the whole array; scalars come as arrays of one.

    Images are row-major: ``{W}`` and ``{H}`` stand for their width and height, by the parameter ``width`` or, where it is
    0, those of a square; ``{D}`` and ``{E}`` for the rows and columns of each plane of a cube.
    """

    def sides(t: str, p: dict, size: str, whole: str) -> str:
        for k, given, root in (("{H}", None, None), ("{W}", p.get("width"), "sqrt"), ("{D}", p.get("rows"), "cbrt"), ("{E}", p.get("cols"), "cbrt")):
            t = t.replace(k, whole.format(a=f"{size}({{x}})", b="{W}") if k == "{H}" else str(int(given)) if given else f"CAST(round({root}({size}({{x}}))) AS INT)")
        return t

    def make(text, number):
        ansi = text is sql

        def build(xs: list[str], p: dict) -> str:
            t = sides(text, p, "len", "({a} // {b})") if ansi else sides(text, p, "size", "CAST({a} DIV {b} AS INT)")
            for k, v in p.items():
                t = t.replace("{" + k + "}", str(int(v)) if not isinstance(v, float) else number(v))
            for k, x in zip(("{x}", "{y}"), xs):
                t = t.replace(k, x)
            return t

        return build

    register(Op(name, inputs, params, make(spark, _num), make(sql, lambda v: _ansi(_num(v))), doc=doc))


def _kernel_only(name: str, f, doc: str = "", **params) -> None:
    register(Op(name, 1, params, kernel=f, doc=doc))


# Mathematics
for _n, _b in {"AbsoluteValue": "abs(v)", "Exponetial": "exp(v)", "Tangent": "tan(v)", "Cosine": "cos(v)", "Sine": "sin(v)", "ArcTangent": "atan(v)", "Cv2Sqrt": "sqrt(v)", "ToFloat": "v", "b-spline": "v", "Supersampling": "v", "ContoursAll": "v", "ThresholdBinaryInverse": "v"}.items():
    each(_n, _b)
each("ArcCosine", "acos(v)", ansi="CASE WHEN abs(v) <= 1 THEN acos(v) ELSE CAST('NaN' AS DOUBLE) END")
each("ArcSine", "asin(v)", ansi="CASE WHEN abs(v) <= 1 THEN asin(v) ELSE CAST('NaN' AS DOUBLE) END")
each("Log", f"CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN -{DBL_MAX} ELSE 0D END", doc="ln with 0 for negatives and the least double for zero")
each("Cv2Log", "CASE WHEN v > 0 THEN ln(v) END", doc="ln, NULL outside its domain")
each("Round", "rint(v)", doc="half to even")
each("Cv2Pow", "pow(v, {power})", power=2)

# Arithmetic with a scalar and between datasets
_DIV = f"CASE WHEN {{d}} = 0 THEN CASE WHEN v = 0 THEN 0D ELSE sign(v) * {DBL_MAX} END ELSE v / {{d}} END"
for _t, _v in (("Int", 2), ("Float", 2.5)):
    each(f"DataAdd{_t}", "v + {value}", value=_v)
    each(f"DataSubtract{_t}", "v - {value}", value=_v)
    each(f"DataMultiply{_t}", "v * {value}", value=_v)
    each(f"DataNumpyMultiply{_t}", "v * {value}", value=_v)
    each(f"DataDivide{_t}", _DIV.replace("{d}", "{value}"), value=_v, doc="x / k; 0/0 is 0, a/0 the greatest double with the sign of a")
#: The quotient whose remainder has the sign of the divisor; a plain floor of v / d is off where the division rounds.
_FLOOR = "rint((v - CASE WHEN (v % {d}) <> 0 AND ((v % {d}) < 0) <> ({d} < 0) THEN (v % {d}) + {d} ELSE v % {d} END) / {d})"
each("DataIntegerDivide", _DIV.replace("v / {d}", _FLOOR).replace("{d}", "{value}"), value=0.3, doc="floor division")
each("Fraction", "v * (1D / nullif({value}, 0D))", value=2)
each("DataAddPair", "v + w", inputs=2)
each("DataSubtractPair", "v - w", inputs=2)
each("DataMultiplyPair", "v * w", inputs=2)
each("DataNumpyMultiplyPair", "v * w", inputs=2)
each("DataDividePair", _DIV.replace("{d}", "w"), inputs=2)
each("DataIntegerDividePair", _DIV.replace("v / {d}", _FLOOR).replace("{d}", "w"), inputs=2)
each("DataAddPairTriple", "v + w + z", inputs=3)
each("FractionDouble", "(v + w) / nullif({value}, 0D)", inputs=2, value=2)
each("FractionTriple", "(v + w + z) / nullif({value}, 0D)", inputs=3, value=2)

# Window weights
_E = "(2D * pi() * i / (n - 1D))"
each("WindowHann", f"v * 0.5D * (1D - (2D * {{lag}} - 1D) * cos{_E})", lag=True)
each("WindowHamming", f"v * (0.53836D - (2D * {{lag}} - 1D) * 0.46164D * cos{_E})", lag=True)
each("WindowTurkey", "v * CASE WHEN i < {alpha} * (n - 1D) / 2D THEN 0.5D * (1D + cos(pi() * (2D * i / ({alpha} * (n - 1D)) - 1D))) WHEN i > (n - 1D) * (1D - {alpha} / 2D) THEN 0.5D * (1D + cos(pi() * (2D * i / ({alpha} * (n - 1D)) - 2D / {alpha} + 1D))) ELSE 1D END", alpha=0.5)
each("WindowCosine", "v * sin(pi() * i / (n - 1D))")
each("WindowLanczos", "v * CASE WHEN 2D * i = n - 1D THEN 1D ELSE sin(pi() * (2D * i / (n - 1D) - 1D)) / (pi() * (2D * i / (n - 1D) - 1D)) END")
each("WindowTriangular", "v * (2D / (n + 1D)) * ((n + 1D) / 2D - abs(i - (n - 1D) / 2D))")
each("WindowBartlett", "v * (2D / (n - 1D)) * ((n - 1D) / 2D - abs(i - (n - 1D) / 2D))")
each("WindowGaussian", "v * exp(-0.5D * pow((i - (n - 1D) / 2D) / ({sigma} * (n - 1D) / 2D), 2D))", sigma=0.4)
each("WindowBartlettHann", f"v * (0.62D - 0.48D * abs(i / (n - 1D) - 0.5D) - 0.38D * cos{_E})")
each("WindowBlackman", f"v * ((1D - {{alpha}}) / 2D - 0.5D * cos{_E} + {{alpha}} / 2D * cos(2D * {_E}))", alpha=0.16)


def _cosine_sum(terms: list[float]) -> str:
    return "v * (" + " ".join(f"{'-' if k % 2 else '+'} {a!r}D * cos({k}D * {_E})" for k, a in enumerate(terms)).lstrip("+ ") + ")"


# Coefficients of the cosine-sum windows.
each("WindowNuttal", _cosine_sum([0.355768, 0.487396, 0.144232, 0.012604]))
each("WindowBlackmanHarris", _cosine_sum([0.35875, 0.48829, 0.14128, 0.01168]))
each("WindowBackmanNuttall", _cosine_sum([0.3635819, 0.4891775, 0.1365995, 0.0106411]))
each("WindowFlatTop", _cosine_sum([1.0, 1.93, 1.29, 0.388, 0.028]))


def _kaiser(x, a=3.0, lag=True):
    n = x.shape[1]
    t = 2 * np.arange(n) / max(n - 1, 1) - 1
    return x * np.i0(math.pi * a * np.sqrt(np.clip(1 - t * t, 0, None))) / np.i0(math.pi * a)


def _planck(x, eps=0.1):
    n = x.shape[1]
    w, i = np.ones(n), np.arange(n)
    edge = eps * (n - 1)
    with np.errstate(all="ignore"):
        for j in (i, n - 1 - i):
            near = (j > 0) & (j < edge)
            z = edge / j - edge / (edge - j)
            w = np.where(near, 1 / (np.exp(np.clip(z, -700, 700)) + 1), w)
            w = np.where(j == 0, 0.0, w)
    return x * w


_kernel_only("WindowKaiser", _kaiser, a=3.0, lag=True)
_kernel_only("WindowPlanckTaper", _planck, eps=0.1)

# Norms and quantities of the row
each("Rebase", "v - lo", ("lo",))
each("MinimumToZero", "v - floor(abs(lo)) * sign(lo)", ("lo",))
each("ZeroOneNorm", "CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0D END", ("lo", "hi"), doc="a constant row becomes zeros")
each("StandardNorm", "CASE WHEN std > 0 THEN (v - mean) / std ELSE 0D END", ("mean", "std"), doc="population deviation; a constant row becomes zeros")
each("ToFloatNorm", "v / nullif(hi, 0D)", ("hi",))
each("ToUint8", "CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255D) ELSE 0D END", ("lo", "hi"))
each("ToUint8Scale", "CASE WHEN hi > lo THEN rint((v - lo) * (255D / (hi - lo))) ELSE 0D END", ("lo", "hi"), doc="each row by its own range")
each("ConvertToCounts", "CASE WHEN hi > lo THEN floor((v - lo) / gap + 1e-9D) ELSE 0D END", ("lo", "hi", "gap"), doc="multiples of the least gap between values")
each("MatchedFiltering", "mean", ("mean",))

# Thresholds and masks
each("ThresholdBinary", "CASE WHEN v > abs({threshold}) THEN abs({maxvalue}) ELSE 0D END", threshold=128.0, maxvalue=255)
each("ThresholdBinaryMax", "CASE WHEN v > floor(hi * {ratio}) THEN {maxvalue} ELSE 0D END", ("hi",), maxvalue=255, ratio=0.5)
each("ThresholdBinaryFloat", "CASE WHEN v < {threshold} THEN 0D ELSE {maxvalue} END", threshold=128.0, maxvalue=255.0)
each("ThresholdToZero", "CASE WHEN v > {threshold} THEN v ELSE 0D END", threshold=128.0)
each("ThresholdToZeroFloat", "CASE WHEN v < {threshold} THEN 0D ELSE v END", threshold=0.5)
each("ThresholdBinaryInverseMask", "CASE WHEN v > {threshold} THEN 0D ELSE 1D END", threshold=0.9)
each("InRange", "CASE WHEN v >= {lower} AND v <= {upper} THEN 255D ELSE 0D END", lower=0, upper=128)
each("MyBinaryThreshold", "CASE WHEN v >= {threshold} THEN 1D ELSE 0D END", threshold=1.2e-09)
each("ThresholdToZeroPixelFloat", "CASE WHEN v < w THEN 0D ELSE v END", inputs=2)
each("SetToZeroIf>Data&Factor", "CASE WHEN v > {alpha} * w THEN 0D ELSE v END", inputs=2, alpha=1.0)
each("SetToZeroIf<Data&Factor", "CASE WHEN v < {alpha} * w THEN 0D ELSE v END", inputs=2, alpha=1)
for _n, _o in {"Equal": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<=", "NotEqual": "<>"}.items():
    each(f"Cv2{_n}", f"CASE WHEN v {_o} w THEN 255D ELSE 0D END", inputs=2)

# 8-bit arithmetic saturates at 0 and 255
_SAT = "least(255D, greatest(0D, {}))"
each("ScalarAdd", _SAT.replace("{}", "rint(v + {scalar})"), scalar=2.0)
each("ScalarSubtract", _SAT.replace("{}", "rint(v - {scalar})"), scalar=2.0)
each("ScalarMultiply", _SAT.replace("{}", "rint(v * {scalar})"), scalar=2.0)
each("ScalarDivide", "CASE WHEN {scalar} = 0 THEN 0D ELSE " + _SAT.replace("{}", "rint(v / nullif({scalar}, 0D))") + " END", scalar=2.0)
each("ScalarMax", "greatest(v, {scalar})", scalar=1)
each("ScalarMin", "least(v, {scalar})", scalar=1)
each("Cv2ScaleAbs", "least(255D, rint(abs(v * {alpha} + {beta})))", alpha=1, beta=0)
each("BitwiseNOT", "255D - v", doc="8-bit complement")
each("AdjustConstrastGamma", "{gain} * pow(v / 255D, {gamma}) * 255D", gamma=2.0, gain=1.0)
each("AdjustConstrastLog", "{gain} * log2(1D + v / 255D) * 255D", gain=1.0)
for _n, _o in {"BitwiseAnd": "&", "BitwiseOr": "|"}.items():
    each(_n, f"CAST(CAST(v AS BIGINT) {_o} CAST(w AS BIGINT) AS DOUBLE)", inputs=2)
each("BitwiseXOr", "CAST(CAST(v AS BIGINT) ^ CAST(w AS BIGINT) AS DOUBLE)", ansi="CAST(xor(CAST(v AS BIGINT), CAST(w AS BIGINT)) AS DOUBLE)", inputs=2)
each("Cv2AbsDiff", "abs(v - w)", inputs=2)
each("AbsDiff", "abs(v - w)", inputs=2)
each("Cv2Add", _SAT.replace("{}", "v + w"), inputs=2)
each("Cv2AddWeighted", _SAT.replace("{}", "rint(v * {alpha} + w * {beta})"), inputs=2, alpha=1, beta=0)
each("Cv2Subtract", _SAT.replace("{}", "v - w"), inputs=2)
each("SubtractSaturate", "greatest(v - w, 0D)", inputs=2)
each("Cv2Multiply", _SAT.replace("{}", "v * w"), inputs=2)
each("Cv2Divide", "CASE WHEN w = 0 THEN 0D ELSE " + _SAT.replace("{}", "rint(v / nullif(w, 0D))") + " END", inputs=2)
each("NumpyDivide", "CASE WHEN w = 0 THEN 0D ELSE v / nullif(w, 0D) END", inputs=2)
each("Cv2Max", "greatest(v, w)", inputs=2)
each("Cv2Min", "least(v, w)", inputs=2)
each("StdDeviationHoleCustom", "sqrt(abs((v - w) * (v - w) / ({kernel_size} * {kernel_size})))", inputs=2, kernel_size=7)

# Slices and reductions
whole("RemoveFeature", "concat(slice({x}, 1, pmod({k}, size({x}))), slice({x}, pmod({k}, size({x})) + 2, size({x})))", "list_concat({x}[1:(({k} % len({x})) + len({x})) % len({x})], {x}[(({k} % len({x})) + len({x})) % len({x}) + 2:])", "drop element k; negative from the end", k=1)
whole(
    "SelectRange",
    "slice({x}, least(CASE WHEN {a} < 0 THEN greatest({a} + size({x}), 0) ELSE {a} END, size({x})) + 1, greatest(least(CASE WHEN {b} < 0 THEN {b} + size({x}) ELSE {b} END, size({x})) - CASE WHEN {a} < 0 THEN greatest({a} + size({x}), 0) ELSE {a} END, 0))",
    "{x}[CASE WHEN {a} < 0 THEN greatest({a} + len({x}), 0) ELSE {a} END + 1:least(CASE WHEN {b} < 0 THEN {b} + len({x}) ELSE {b} END, len({x}))]",
    "elements a..b-1, negative from the end, clamped", a=3, b=20,
)
whole("CutDataLead", "slice({x}, greatest({k}, 0) + 1, size({x}))", "{x}[greatest({k}, 0) + 1:]", "drop the first k samples", k=10)
whole("myConcatenate", "concat({x}, {y})", "list_concat({x}, {y})", inputs=2)
whole("mySubSampleData", "slice({x}, CAST(floor((size({x}) - {size}) / {step}) AS INT) * {step} + 1, {size})", "{x}[CAST(floor((len({x}) - {size}) / {step}) AS INT) * {step} + 1:CAST(floor((len({x}) - {size}) / {step}) AS INT) * {step} + {size}]", "the last full window", size=10, step=3)
whole("GetCentroids", "slice({x}, 1, 2)", "{x}[1:2]")
whole("MySum", "array(aggregate({x}, 0D, (a, v) -> a + v))", "[list_sum({x})]")
whole("MyProd", "array(aggregate({x}, 1D, (a, v) -> a * v))", "[list_product({x})]")
whole("MyNorm", "array(CASE WHEN {p} = 1 THEN array_max(transform({x}, v -> abs(v))) ELSE sqrt(aggregate({x}, 0D, (a, v) -> a + v * v)) END)", "[CASE WHEN {p} = 1 THEN list_max(list_transform({x}, lambda v: abs(v))) ELSE sqrt(list_sum(list_transform({x}, lambda v: v * v))) END]", "norm of the row as a matrix of one row", p=2)
whole("RMS2D", "transform(sequence(0, {H} - 1), r -> sqrt(aggregate(slice({x}, r * {W} + 1, {W}), 0D, (a, v) -> a + v * v)))", "list_transform(range(0, {H}), lambda r: sqrt(list_sum(list_transform({x}[r * {W} + 1:r * {W} + {W}], lambda v: v * v))))", "L2 norm of the rows of an image", width=0)
whole("MyDiff", "transform({x}, (v, i) -> v - CASE WHEN i = 0 THEN 0D ELSE {x}[i - 1] END)", "list_transform({x}, lambda v, i: v - CASE WHEN i = 1 THEN 0 ELSE {x}[i - 1] END)", "first difference; the first value stays")
whole("MyAverager", "transform({x}, (v, i) -> aggregate(slice({x}, greatest(i - {w} DIV 2, 0) + 1, least(i + ({w} - 1) DIV 2, size({x}) - 1) - greatest(i - {w} DIV 2, 0) + 1), 0D, (a, u) -> a + u) / {w})", "list_transform({x}, lambda v, i: list_sum({x}[greatest(i - {w} // 2, 1):least(i + ({w} - 1) // 2, len({x}))]) / {w})", "moving mean over w samples, zeros beyond the edges", w=5)
whole("MyAutoCorr", "transform(sequence(0, size({x}) - 1), k -> aggregate(sequence(0, size({x}) - 1), 0D, (a, i) -> a + {x}[i] * {x}[(i + k) % size({x})]))", "list_transform(range(0, len({x})), lambda k: list_sum(list_transform(range(0, len({x})), lambda i: {x}[i + 1] * {x}[(i + k) % len({x}) + 1])))", "circular autocorrelation of each row")
whole("CrossCorrelation", "transform(sequence(0, size({x}) - 1), k -> aggregate(sequence(0, size({x}) - 1), 0D, (a, i) -> a + {x}[i] * {y}[(i + k) % size({x})]))", "list_transform(range(0, len({x})), lambda k: list_sum(list_transform(range(0, len({x})), lambda i: {x}[i + 1] * {y}[(i + k) % len({x}) + 1])))", "circular cross-correlation", inputs=2)
whole("ECDF", "concat(transform(sequence(0, {c} - 1), k -> array_sort({x})[CAST(rint(k * (size({x}) - 1) / CAST({c} - 1 AS DOUBLE)) AS INT)]), array(aggregate({x}, 0D, (a, v) -> a + v) / size({x})))", "list_concat(list_transform(range(0, {c}), lambda k: list_sort({x})[CAST(round_even(k * (len({x}) - 1) / CAST({c} - 1 AS DOUBLE), 0) AS INT) + 1]), [list_avg({x})])", "order statistics at even steps, and the mean", c=5)
whole("ArgMax", "array((array_position({x}, array_max({x})) - 1) / {rate})", "[(list_position({x}, list_max({x})) - 1) / {rate}]", rate=1.0)
whole("ArgMin", "array((array_position({x}, array_min({x})) - 1) / {rate})", "[(list_position({x}, list_min({x})) - 1) / {rate}]", rate=1.0)
whole("MaxLoc", "transform(array(array_position({x}, array_max({x})) - 1), p -> CAST(p AS DOUBLE))", "[CAST(list_position({x}, list_max({x})) - 1 AS DOUBLE)]", "place of the maximum, first of equals")
whole("MinLoc", "transform(array(array_position({x}, array_min({x})) - 1), p -> CAST(p AS DOUBLE))", "[CAST(list_position({x}, list_min({x})) - 1 AS DOUBLE)]", "place of the minimum, first of equals")
whole("min_max_loc", "array(array_min({x}), array_max({x}), CAST(array_position({x}, array_min({x})) - 1 AS DOUBLE), CAST(array_position({x}, array_max({x})) - 1 AS DOUBLE))", "[list_min({x}), list_max({x}), CAST(list_position({x}, list_min({x})) - 1 AS DOUBLE), CAST(list_position({x}, list_max({x})) - 1 AS DOUBLE)]")
whole("nlargest", "slice(sort_array(array_distinct({x}), false), 1, {k})", "list_reverse_sort(list_distinct({x}))[1:{k}]", "the k largest distinct values", k=5)
whole("DepthEstimate", "array(CASE WHEN size({x}) < 2 THEN -1D ELSE (element_at({x}, -1) - {x}[0]) / {rate} * cos(asin(sin({angle}) / 1.33D)) END)", "[CASE WHEN len({x}) < 2 THEN -1 ELSE ({x}[-1] - {x}[1]) / {rate} * cos(asin(sin({angle}) / CAST(1.33 AS DOUBLE))) END]", rate=1.0, angle=0.3)
whole("CenterOfMass", "element_at(transform(array(aggregate({x}, 0D, (a, v) -> a + v)), s -> array(aggregate(transform({x}, (v, i) -> v * (i DIV {W})), 0D, (a, v) -> a + v) / s, aggregate(transform({x}, (v, i) -> v * (i % {W})), 0D, (a, v) -> a + v) / s)), 1)", "[list_sum(list_transform({x}, lambda v, i: v * ((i - 1) // {W}))) / list_sum({x}), list_sum(list_transform({x}, lambda v, i: v * ((i - 1) % {W}))) / list_sum({x})]", "weighted centre (row, column) of an image", width=0)
whole("Cv2Transpose", "transform(sequence(0, size({x}) - 1), i -> {x}[(i % {H}) * {W} + i DIV {H}])", "list_transform(range(0, len({x})), lambda i: {x}[(i % {H}) * {W} + i // {H} + 1])", "of an image", width=0)
whole("Select1D", "slice({x}, pmod({ind}, {H}) * {W} + 1, {W})", "{x}[(({ind} % {H}) + {H}) % {H} * {W} + 1:(({ind} % {H}) + {H}) % {H} * {W} + {W}]", "one row of an image", ind=2, width=0)
whole("Select2D", "array({x}[pmod({a}, {H}) * {W} + pmod({b}, {W})])", "[{x}[(({a} % {H}) + {H}) % {H} * {W} + (({b} % {W}) + {W}) % {W} + 1]]", "one pixel of an image", a=2, b=3, width=0)
whole("Select3D", "array({x}[pmod({a}, size({x}) DIV ({D} * {E})) * {D} * {E} + pmod({b}, {D}) * {E} + pmod({c}, {E})])", "[{x}[CAST((({a} % (len({x}) // ({D} * {E}))) + (len({x}) // ({D} * {E}))) % (len({x}) // ({D} * {E})) * {D} * {E} + (({b} % {D}) + {D}) % {D} * {E} + (({c} % {E}) + {E}) % {E} AS INT) + 1]]", "one cell of planes by rows by columns, a cube if no sizes are given", a=1, b=2, c=3, rows=0, cols=0)
_POOL = "CASE WHEN {H} < {b} OR {W} < {b} THEN array() ELSE transform(sequence(0, CAST(({H} DIV {b}) * ({W} DIV {b}) AS INT) - 1), k -> {f}) END"
_CELLS = "transform(sequence(0, {b} * {b} - 1), j -> {x}[CAST((k DIV ({W} DIV {b}) * {b} + j DIV {b}) * {W} + k % ({W} DIV {b}) * {b} + j % {b} AS INT)])"
_LCELLS = "list_transform(range(0, {b} * {b}), lambda j: {x}[(k // ({W} // {b}) * {b} + j // {b}) * {W} + k % ({W} // {b}) * {b} + j % {b} + 1])"
for _n, _s, _q in (("Mean", "aggregate(C, 0D, (a, v) -> a + v) / ({b} * {b})", "list_avg(C)"), ("Max", "array_max(C)", "list_max(C)"), ("Median", "element_at(transform(array(array_sort(C)), s -> (s[({b} * {b} - 1) DIV 2] + s[({b} * {b}) DIV 2]) / 2D), 1)", "list_median(C)")):
    whole(f"LocalPooling{_n}", _POOL.replace("{f}", _s.replace("C", _CELLS)), "list_transform(range(0, ({H} // {b}) * ({W} // {b})), lambda k: " + _q.replace("C", _LCELLS) + ")", f"{_n.lower()} over b by b blocks of an image", b=4, width=0)
whole("ThresholdNLargest", "element_at(transform(array(element_at(sort_array(array_distinct({x}), false), least({k}, size(array_distinct({x}))))), t -> transform({x}, v -> CASE WHEN v > t THEN v ELSE 0D END)), 1)", "list_transform([list_reverse_sort(list_distinct({x}))[least({k}, len(list_distinct({x})))]], lambda t: list_transform({x}, lambda v: CASE WHEN v > t THEN v ELSE 0 END))[1]", "zero all that is not above the k-th largest distinct value", k=5)
whole("ThresholdNLargestBinary", "element_at(transform(array(element_at(sort_array(array_distinct({x}), false), least({k}, size(array_distinct({x}))))), t -> transform({x}, v -> CASE WHEN v > t THEN 255D ELSE 0D END)), 1)", "list_transform([list_reverse_sort(list_distinct({x}))[least({k}, len(list_distinct({x})))]], lambda t: list_transform({x}, lambda v: CASE WHEN v > t THEN 255 ELSE 0 END))[1]", k=5)
whole("MySnapshot", "transform({x}, (v, i) -> CASE WHEN i DIV {W} >= CAST({y}[0] AS INT) - {p} AND i DIV {W} < CAST({y}[0] AS INT) + {p} AND i % {W} >= CAST({y}[1] AS INT) - {p} AND i % {W} < CAST({y}[1] AS INT) + {p} THEN v ELSE 0D END)", "list_transform({x}, lambda v, i: CASE WHEN (i - 1) // {W} >= CAST(trunc({y}[1]) AS INT) - {p} AND (i - 1) // {W} < CAST(trunc({y}[1]) AS INT) + {p} AND (i - 1) % {W} >= CAST(trunc({y}[2]) AS INT) - {p} AND (i - 1) % {W} < CAST(trunc({y}[2]) AS INT) + {p} THEN v ELSE 0 END)", "keep a square around a place, zero the rest", inputs=2, p=2, width=0)
whole("MultiplyTransposed", "transform(sequence(0, {W} * {W} - 1), k -> aggregate(sequence(0, {H} - 1), 0D, (a, j) -> a + {x}[j * {W} + k DIV {W}] * {x}[j * {W} + k % {W}]))", "list_transform(range(0, {W} * {W}), lambda k: list_sum(list_transform(range(0, {H}), lambda j: {x}[j * {W} + k // {W} + 1] * {x}[j * {W} + k % {W} + 1])))", "transpose times matrix", width=0)
whole("ConvertBW", "transform(sequence(0, size({x}) DIV 3 - 1), p -> rint(0.114D * {x}[3 * p] + 0.587D * {x}[3 * p + 1] + 0.299D * {x}[3 * p + 2]))", "list_transform(range(0, len({x}) // 3), lambda p: round_even(CAST(0.114 AS DOUBLE) * {x}[3 * p + 1] + CAST(0.587 AS DOUBLE) * {x}[3 * p + 2] + CAST(0.299 AS DOUBLE) * {x}[3 * p + 3], 0))", "blue, green, red triples to grey")

# Random rows, reproducible: drawn from a hash of value, place and seed rather than from a generator's state
_U = "(pmod(xxhash64(r, i), 2147483648L) + 0.5D) / 2147483648D"
_U2 = "(pmod(xxhash64(i, r), 2147483648L) + 0.5D) / 2147483648D"


#: The row is hashed once; equal rows draw equal numbers.
_R = "element_at(transform(array(xxhash64({x}, {seed})), r -> transform({x}, (v, i) -> "


def _drawn(name: str, text: str, doc: str, **params) -> None:
    def native(xs: list[str], p: dict) -> str:
        t = text
        for k, v in p.items():
            t = t.replace("{" + k + "}", str(int(v)) if k == "seed" else _num(v))
        return t.replace("{x}", xs[0])

    register(Op(name, 1, params, native, doc=doc))


_drawn("RandomUniform", _R + "{low} + ({high} - {low}) * " + _U + ")), 1)", "uniform numbers in place of the row", low=0, high=255, seed=7)
_drawn("RandomNormal", _R + "{mean} + {std} * sqrt(-2D * ln(" + _U + ")) * cos(2D * pi() * " + _U2 + "))), 1)", "normal numbers in place of the row", mean=128, std=1, seed=7)
_drawn("RandomShuffle", "transform(array_sort(transform({x}, (v, i) -> named_struct('h', xxhash64(v, i, {seed}), 'v', v))), s -> s.v)", "the row's values in another order", seed=7)
