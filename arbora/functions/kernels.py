"""Numpy kernels for what Spark has no expression for: transforms, recursive filters, image filters, morphology.

Every kernel takes a batch, ``(rows, samples)`` for signals or ``(rows, height, width)`` for images, and works on all
rows at once. Borders are named as in numpy's ``pad``: 'reflect' does not repeat the edge, 'symmetric' does.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from arbora.functions.registry import Op, register


def signal(name: str, doc: str = "", inputs: int = 1, **params):
    def put(f):
        register(Op(name, inputs, params, kernel=f, doc=doc or (f.__doc__ or "")))
        return f

    return put


def image(name: str, doc: str = "", inputs: int = 1, fit=None, **params):
    def put(f):
        register(Op(name, inputs, params, kernel=f, image=True, doc=doc or (f.__doc__ or ""), fit=fit))
        return f

    return put


def odd(k) -> int:
    """A usable kernel size: positive, at least 1, odd."""
    k = max(1, abs(int(k)))
    return k + 1 - k % 2


def windows(x: np.ndarray, kh: int, kw: int, border: str = "reflect") -> np.ndarray:
    """(rows, h, w, kh, kw) neighbourhoods of every pixel."""
    lo, hi = (kh - 1) // 2, kh // 2
    left, right = (kw - 1) // 2, kw // 2
    if border == "reflect" and (max(lo, hi) >= x.shape[1] or max(left, right) >= x.shape[2]):
        border = "symmetric"
    p = np.pad(x, ((0, 0), (lo, hi), (left, right)), border)
    return sliding_window_view(p, (kh, kw), axis=(1, 2))


def correlate(x: np.ndarray, k: np.ndarray, border: str = "reflect") -> np.ndarray:
    return np.einsum("rhwab,ab->rhw", windows(x, *k.shape, border), k)


def gauss(size: int, sigma: float) -> np.ndarray:
    i = np.arange(size) - (size - 1) / 2
    w = np.exp(-(i**2) / (2 * max(sigma, 1e-9) ** 2))
    return w / w.sum()


def blur(x: np.ndarray, sigma: float, border: str = "edge", size: int | None = None) -> np.ndarray:
    size = size or 2 * int(4 * sigma + 0.5) + 1
    g = gauss(size, sigma)
    return correlate(correlate(x, g[:, None], border), g[None, :], border)


def disk(r: int) -> np.ndarray:
    i = np.arange(-r, r + 1)
    return (i[:, None] ** 2 + i[None, :] ** 2) <= r * r


def over(x: np.ndarray, mask: np.ndarray, f, border: str = "symmetric") -> np.ndarray:
    """A statistic of the masked neighbourhood of every pixel."""
    return f(windows(x, *mask.shape, border)[..., mask.astype(bool)])


# --- signals -------------------------------------------------------------------------------------------------------


@signal("MyCumSum", "running sum")
def cum_sum(x):
    return np.cumsum(x, axis=1)


@signal("MyCumProd", "running product")
def cum_prod(x):
    return np.cumprod(x, axis=1)


@signal("FFT", "magnitude of the Fourier transform")
def fft(x):
    return np.abs(np.fft.fft(x, axis=1))


def _dct_matrix(n: int, kind: int, ortho: bool) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    if kind == 1:
        m = 2 * np.cos(math.pi * k * i / max(n - 1, 1))
        m[:, 0], m[:, -1] = m[:, 0] / 2, m[:, -1] / 2
        return m
    m = 2 * np.cos(math.pi * (2 * i + 1) * k / (2 * n)) if kind == 2 else 2 * np.cos(math.pi * (2 * k + 1) * i / (2 * n))
    if kind == 3:
        m[:, 0] /= 2
    if ortho:
        s = np.full(n, math.sqrt(1 / (2 * n)))
        s[0] = math.sqrt(1 / (4 * n))
        m = m * s[:, None] if kind == 2 else np.where(i == 0, math.sqrt(1 / n), m * math.sqrt(1 / (2 * n)))
    return m


@signal("MyDCT", "cosine transform of kind t % 3 + 1, orthonormal if norm is odd", transform=1, norm=1)
def dct(x, transform=1, norm=1):
    return x @ _dct_matrix(x.shape[1], int(transform) % 3 + 1, bool(int(norm) % 2)).T


#: The low-pass taps of the third Daubechies wavelet.
DB3 = np.array([0.035226291882100656, -0.08544127388224149, -0.13501102001039084, 0.4598775021193313, 0.8068915093133388, 0.3326705529509569])


@signal("MyDWT", "wavelet decomposition to the deepest level, parts joined from coarse to fine")
def dwt(x):
    low, high = DB3, DB3[::-1] * np.array([-1, 1] * 3)
    parts, a = [], x
    for _ in range(max(1, int(math.log2(max(x.shape[1] / (len(low) - 1), 2))))):
        p = np.pad(a, ((0, 0), (len(low) - 1,) * 2), "symmetric")
        w = sliding_window_view(p, len(low), axis=1)[:, 1::2]
        parts.append(w @ high[::-1])
        a = w @ low[::-1]
    return np.concatenate([a, *parts[::-1]], axis=1)


@signal("KalmanFilter", "scalar smoother from the first sample", q=1e-5, r=0.01)
def kalman(x, q=1e-5, r=0.01):
    out = np.empty_like(x)
    est, p = x[:, 0].copy(), np.ones(len(x))
    out[:, 0] = est
    for t in range(1, x.shape[1]):
        p = p + q
        gain = p / (p + r)
        est = est + gain * (x[:, t] - est)
        p = (1 - gain) * p
        out[:, t] = est
    return out


@signal("LinearPredictiveCoding", "order-p coefficients by the normal equations", p=5)
def lpc(x, p=5):
    n, p = x.shape[1], max(1, min(int(p), x.shape[1] - 1))
    r = np.stack([(x[:, : n - k] * x[:, k:]).sum(axis=1) for k in range(p + 1)], axis=1)
    a = r[:, np.abs(np.arange(p)[:, None] - np.arange(p)[None, :])] + 1e-12 * np.eye(p)
    return np.linalg.solve(a, r[:, 1:, None])[..., 0]


@signal("WienerFilter", "local mean and variance over 3 samples, noise as their mean variance")
def wiener(x):
    w = sliding_window_view(np.pad(x, ((0, 0), (1, 1))), 3, axis=1)
    mean, var = w.mean(axis=2), (w**2).mean(axis=2) - w.mean(axis=2) ** 2
    noise = var.mean(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        return np.where(var < noise, mean, mean + (1 - noise / var) * (x - mean))


def savgol_taps(n: int, order: int, deriv: int = 0) -> np.ndarray:
    half = n // 2
    a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return np.linalg.pinv(a)[deriv] * math.factorial(deriv)


@signal("SavitzkyGolayFilter", "local polynomial smoothing, edges mirrored about the end value", size=11, order=3, deriv=0)
def savgol(x, size=11, order=3, deriv=0):
    size = min(odd(size), odd(x.shape[1]) - 2 if x.shape[1] % 2 == 0 else x.shape[1])
    order = min(int(order), size - 2)
    half = size // 2
    first = x[:, :1] - np.abs(x[:, half:0:-1] - x[:, :1])
    last = x[:, -1:] + np.abs(x[:, -2 : -half - 2 : -1] - x[:, -1:])
    w = sliding_window_view(np.concatenate([first, x, last], axis=1), size, axis=1)
    return w @ savgol_taps(size, order, min(int(deriv), order))


@signal("PeakFinder", "values at maxima that stand out by delta, zero elsewhere", delta=0.2, look_for_max=1)
def peaks(x, delta=0.2, look_for_max=1):
    n = len(x)
    out = np.zeros_like(x)
    top, bottom = np.full(n, -np.inf), np.full(n, np.inf)
    at, up = np.zeros(n, int), np.full(n, bool(look_for_max))
    rows = np.arange(n)
    for t in range(x.shape[1]):
        v = x[:, t]
        at = np.where(v > top, t, at)
        top, bottom = np.maximum(top, v), np.minimum(bottom, v)
        down = up & (v < top - delta)
        out[rows[down], at[down]] = top[down]
        rise = ~up & (v > bottom + delta)
        bottom = np.where(down, v, bottom)
        top, at = np.where(rise, v, top), np.where(rise, t, at)
        up = (up & ~down) | rise
    return out


@signal("MyInformedSearch", "places of the steepest sign change of curvature before each peak, -1 for the rest", inputs=2, search=5, least=0.08)
def informed_search(x, peak, search=5, least=0.08):
    curve = savgol(x, 11, 3, 2)
    change = np.zeros(x.shape, bool)
    change[:, 1:] = np.sign(curve[:, 1:]) != np.sign(curve[:, :-1])
    width = x.shape[1]
    lo, hi = np.maximum(np.arange(width) - 3, 0), np.minimum(np.arange(width) + 3, width - 1)
    slope = np.abs(np.log10(np.abs(x[:, hi]) + 1e-12) - np.log10(np.abs(x[:, lo]) + 1e-12)) / 6
    out = np.full(x.shape, -1.0)
    for r in range(len(x)):
        k = 0
        for t in np.flatnonzero(peak[r]):
            near = [u for u in range(max(0, t - int(search)), t) if change[r, u]]
            if near and slope[r, best := max(near, key=lambda u: slope[r, u])] >= least:
                out[r, k], k = best, k + 1
    return out


@signal("RichardsonLucy", "deconvolution with a flat point spread", iterations=50, spread=5)
def richardson_lucy(x, iterations=50, spread=5):
    n, width = x.shape[1], max(1, min(int(spread), x.shape[1]))
    k = np.fft.rfft(np.r_[np.ones(width) / width, np.zeros(n - width)])
    x = np.abs(x)
    est = np.full_like(x, 0.5)
    for _ in range(int(iterations)):
        seen = np.fft.irfft(np.fft.rfft(est, axis=1) * k, n, axis=1)
        est = est * np.fft.irfft(np.fft.rfft(x / np.maximum(seen, 1e-12), axis=1) * k.conj(), n, axis=1)
    return est


@signal("AccumulateWeighted", "running average of frames, seeded with the first, which is not given; a row of n samples has frames of sqrt(n), or as long as asked; a last frame that is not full is left out", alpha=0.01, frame=0)
def accumulate(x, alpha=0.01, frame=0):
    size = int(frame) or max(1, math.isqrt(x.shape[1]))
    f = x[:, : x.shape[1] // size * size].reshape(len(x), -1, size)
    if not f.shape[1]:
        return x[:, :0]
    avg, out = f[:, 0], []
    for t in range(1, f.shape[1]):
        avg = (1 - alpha) * avg + alpha * f[:, t]
        out.append(avg)
    return np.concatenate(out, axis=1) if out else x[:, :0]


@signal("GaussianPeakEM", "two-component mixture of the samples: weights, means, deviations")
def gaussian_em(x):
    mean = np.quantile(x, [0.25, 0.75], axis=1).T
    dev = np.repeat(x.std(axis=1, keepdims=True) + 1e-9, 2, axis=1)
    weight = np.full_like(mean, 0.5)
    open_ = np.arange(len(x))  # rows that still move; each row stops by itself
    for _ in range(200):
        v, m, s, w = x[open_], mean[open_], dev[open_], weight[open_]
        d = w[:, None] * np.exp(-0.5 * ((v[..., None] - m[:, None]) / s[:, None]) ** 2) / s[:, None] + 1e-300
        r = d / d.sum(axis=2, keepdims=True)
        n = r.sum(axis=1) + 1e-12
        new = (r * v[..., None]).sum(axis=1) / n
        dev[open_] = np.sqrt((r * (v[..., None] - new[:, None]) ** 2).sum(axis=1) / n) + 1e-9
        weight[open_], mean[open_] = n / x.shape[1], new
        open_ = open_[np.abs(new - m).max(axis=1) >= 1e-4]
        if not len(open_):
            break
    return np.concatenate([weight, mean, dev], axis=1)


def fit(f, x, start):
    """Levenberg-Marquardt with a numeric Jacobian, for all rows at once."""
    t = np.arange(1, x.shape[1] + 1, dtype=float)
    p, lam = start.copy(), np.full(len(x), 1e-2)
    err = ((f(t, p) - x) ** 2).sum(axis=1)
    for _ in range(60):
        base = f(t, p)
        jac = np.stack([(f(t, p + 1e-5 * np.eye(p.shape[1])[k]) - base) / 1e-5 for k in range(p.shape[1])], axis=2)
        jac = np.nan_to_num(jac, posinf=0, neginf=0)
        h = np.einsum("rti,rtj->rij", jac, jac)
        g = np.einsum("rti,rt->ri", jac, x - base)
        h = h + lam[:, None, None] * (np.eye(p.shape[1]) * (np.einsum("rii->ri", h)[:, None, :] + 1e-9))
        trial = p + np.linalg.solve(h, g[..., None])[..., 0]
        e2 = np.nan_to_num(((f(t, trial) - x) ** 2).sum(axis=1), nan=np.inf)
        better = e2 < err
        p, err = np.where(better[:, None], trial, p), np.where(better, e2, err)
        lam = np.clip(np.where(better, lam / 3, lam * 4), 1e-9, 1e9)
    return p


def _gaussian(t, p):
    return p[:, :1] * np.exp(-0.5 * ((t - p[:, 1:2]) / (np.abs(p[:, 2:3]) + 1e-6)) ** 2)


@signal("my_gaussian_peak_lm", "each row replaced by the Gaussian peak that fits it best")
def gaussian_lm(x):
    start = np.stack([x.max(axis=1), x.argmax(axis=1) + 1.0, np.full(len(x), x.shape[1] / 8)], axis=1)
    return _gaussian(np.arange(1, x.shape[1] + 1.0), fit(_gaussian, x, start))


def _lognormal(t, p):
    s = np.abs(p[:, 2:3]) + 1e-3
    return p[:, :1] / (t * s) * np.exp(-0.5 * ((np.log(t) - p[:, 1:2]) / s) ** 2)


@signal("LognormalLM", "each row replaced by the lognormal curve that fits it best")
def lognormal_lm(x):
    start = np.stack([np.maximum(x.sum(axis=1), 1e-3), np.full(len(x), math.log(x.shape[1] / 2)), np.full(len(x), 0.7)], axis=1)
    return _lognormal(np.arange(1, x.shape[1] + 1.0), fit(_lognormal, x, start))


@signal("my_nnls_deconvolution", "non-negative source whose blur by a flat spread is nearest to the row", spread=5)
def nnls(x, spread=5):
    n, width = x.shape[1], odd(spread)
    a = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]) <= width // 2
    a = a / width
    step = 1 / np.linalg.norm(a, 2) ** 2
    s = np.maximum(x, 0)
    for _ in range(300):
        s = np.maximum(s - step * (s @ a - x) @ a, 0)
    return s


@signal("my_waveform_fitting_2", "row as a sum of peaks: the strongest Gaussian is fitted and taken off, k times", k=2)
def waveforms(x, k=2):
    rest, total = x, np.zeros_like(x)
    for _ in range(max(1, int(k))):
        g = gaussian_lm(rest)
        total, rest = total + g, rest - g
    return total


register(Op("my_progressive_waveform_decomposition", 1, {"k": 4}, kernel=waveforms, doc="as my_waveform_fitting_2, with more peaks"))
register(Op("savitzky_golay", 1, {"size": 11, "order": 3, "deriv": 0}, kernel=savgol))


@signal("gaussian_hmm", "states of a hidden Markov chain with k Gaussian emissions, by Viterbi", k=2)
def hmm(x, k=2):
    k = max(2, int(k))
    mean = np.quantile(x, (np.arange(k) + 0.5) / k, axis=1).T
    dev = x.std(axis=1)[:, None, None] / k + 1e-9
    emit = -0.5 * ((x[..., None] - mean[:, None]) / dev) ** 2
    move = np.log(np.full((k, k), 0.1 / (k - 1)) + (0.9 - 0.1 / (k - 1)) * np.eye(k))
    score, back = emit[:, 0], []
    for t in range(1, x.shape[1]):
        path = score[:, :, None] + move
        back.append(path.argmax(axis=1))
        score = path.max(axis=1) + emit[:, t]
    out = np.empty(x.shape)
    state = score.argmax(axis=1)
    out[:, -1] = state
    for t in range(x.shape[1] - 2, -1, -1):
        state = back[t][np.arange(len(x)), state]
        out[:, t] = state
    return out


# --- images: filters -------------------------------------------------------------------------------------------------

#: First and second derivative taps, with their smoothing partners.
SOBEL, SMOOTH, SECOND = np.array([-1.0, 0, 1]), np.array([1.0, 2, 1]), np.array([1.0, -2, 1])


def deriv_taps(order: int, size: int) -> np.ndarray:
    """Taps of a derivative of some order, smoothed to an odd size by repeated (1, 1)."""
    t = np.array([1.0])
    for _ in range(order):
        t = np.convolve(t, [-1.0, 1.0])
    while len(t) < size:
        t = np.convolve(t, [1.0, 1.0])
    return t[::-1] if order % 2 == 0 else t


def sobel_xy(x, dx: int, dy: int, size: int = 3, border: str = "reflect"):
    size = max(odd(size), dx + 1 + dx % 2, dy + 1 + dy % 2)
    return correlate(x, np.outer(deriv_taps(dy, size), deriv_taps(dx, size)), border)


@image("GradientMagnitude", "length of the gradient", ksize=3)
def gradient_magnitude(x, ksize=3):
    return np.hypot(sobel_xy(x, 1, 0, ksize), sobel_xy(x, 0, 1, ksize))


@image("GradientWeighted", "weighted absolute derivatives", ksize=3, wx=0.5, wy=0.5)
def gradient_weighted(x, ksize=3, wx=0.5, wy=0.5):
    return wx * np.abs(sobel_xy(x, 1, 0, ksize)) + wy * np.abs(sobel_xy(x, 0, 1, ksize))


@image("SobelFilter", "gradient length, unit weights")
def sobel_filter(x):
    k = np.outer(SMOOTH, SOBEL) / 4
    return np.sqrt((correlate(x, k, "symmetric") ** 2 + correlate(x, k.T, "symmetric") ** 2) / 2)


@image("HighpassSobelDerivative", "mixed derivative", dx=1, dy=1, ksize=5, scale=1, delta=0)
def sobel_derivative(x, dx=1, dy=1, ksize=5, scale=1, delta=0):
    return sobel_xy(x, int(dx) % 3 + (int(dx) % 3 == 0) * 3, int(dy) % 3 + (int(dy) % 3 == 0) * 3, ksize) * scale + delta


@image("HighpassLaplacian", "sum of second derivatives", ksize=3, scale=1, delta=0)
def laplacian(x, ksize=3, scale=1, delta=0):
    return (sobel_xy(x, 2, 0, ksize) + sobel_xy(x, 0, 2, ksize)) * scale + delta


@image("HighpassIrst", "sharpening by the four neighbours")
def sharpen(x):
    return correlate(x, np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0.0]]))


@image("HighpassUnsharpMask", "alpha x - beta blur(x)", size=9, sigma=10, alpha=1.5, beta=0.5)
def unsharp(x, size=9, sigma=10, alpha=1.5, beta=0.5):
    return alpha * x - beta * blur(x, sigma, "reflect", odd(size))


@image("LowpassFilterAverage", "box mean", size=5)
def box(x, size=5):
    k = odd(size)
    return windows(x, k, k).mean(axis=(3, 4))


@image("LowpassFilterGaussian", "separable Gaussian", kx=3, ky=3, sx=0.5, sy=0.5)
def gaussian_xy(x, kx=3, ky=3, sx=0.5, sy=0.5):
    return correlate(correlate(x, gauss(odd(ky), sy)[:, None]), gauss(odd(kx), sx)[None, :])


@image("GaussianFilter", "Gaussian, edges repeated", sigma=1.0)
def gaussian_filter(x, sigma=1.0):
    return blur(x, sigma)


@image("LowpassFilterMedian", "median blur, edges repeated", size=5)
def median_blur(x, size=5):
    k = odd(size)
    return np.median(windows(x, k, k, "edge"), axis=(3, 4))


@image("MedianFilter", "median, zeros beyond the edges", size=3)
def median_filter(x, size=3):
    k = odd(size)
    return np.median(windows(x, k, k, "constant"), axis=(3, 4))


@image("SkiMedianFilter", "median over a disk", r=3)
def disk_median(x, r=3):
    return over(x, disk(int(r)), lambda w: np.median(w, axis=-1))


@image("MeanFilter", "mean over a disk", r=3)
def disk_mean(x, r=3):
    return over(x, disk(int(r)), lambda w: w.mean(axis=-1))


@image("LowpassFilterBilateral", "mean weighted by distance and by difference in value", d=9, color=75, space=75)
def bilateral(x, d=9, color=75, space=75):
    k = odd(d)
    i = np.arange(k) - k // 2
    near = np.exp(-(i[:, None] ** 2 + i[None, :] ** 2) / (2.0 * space**2)) * disk(k // 2)
    w = windows(x, k, k)
    like = near * np.exp(-((w - x[..., None, None]) ** 2) / (2.0 * color**2))
    return (w * like).sum(axis=(3, 4)) / like.sum(axis=(3, 4))


def _frequency(x, h):
    return np.abs(np.fft.ifft2(np.fft.fft2(x, axes=(1, 2)) * h, axes=(1, 2)))


def _grid(x):
    return np.meshgrid(np.fft.fftfreq(x.shape[1]), np.fft.fftfreq(x.shape[2]), indexing="ij")


def _ellipsoid(x, size):
    fy, fx = _grid(x)
    r = math.pi * size * np.hypot(fx, fy)
    # 2 J1(r) / r by Bessel's integral, at the middles of 200 steps
    t = (np.arange(200) + 0.5) * math.pi / 200
    j1 = np.cos(t[:, None, None] - r * np.sin(t)[:, None, None]).mean(axis=0)
    return np.where(r < 1e-9, 1.0, 2 * j1 / np.maximum(r, 1e-9))


def _gauss_f(x, sigma):
    fy, fx = _grid(x)
    return np.exp(-2 * (math.pi * sigma) ** 2 * (fx**2 + fy**2))


def _uniform_f(x, size):
    fy, fx = _grid(x)
    return np.sinc(size * fx) * np.sinc(size * fy)


def _shift_f(x, shift):
    fy, fx = _grid(x)
    return np.exp(-2j * math.pi * shift * (fx + fy))


for _low, _high, _f, _p, _v in (("LowpassFilterEllipsoid", "HighpassFourierEllipsoid", _ellipsoid, "size", 3), ("LowpassFourierGaussian", "HighpassFourierGaussian", _gauss_f, "sigma", 3), ("LowpassFilterUniform", "HighpassFourierUniform", _uniform_f, "size", 3), ("LowpassFourierShift", "HighpassFourierShift", _shift_f, "shift", 3)):

    def _lo(x, _f=_f, _p=_p, **p):
        return _frequency(x, _f(x, p[_p]))

    def _hi(x, _f=_f, _p=_p, **p):
        return x - _frequency(x, _f(x, p[_p]))

    register(Op(_low, 1, {_p: _v}, kernel=_lo, image=True, doc="low pass in the frequency domain"))
    register(Op(_high, 1, {_p: _v}, kernel=_hi, image=True, doc="input less the low pass"))


@image("Cv2RMS", "local population deviation", size=5)
def local_std(x, size=5):
    return np.sqrt(np.maximum(box(x**2, size) - box(x, size) ** 2, 0))


@image("StdDeviation", "distance from the box mean over the box size", size=5)
def from_mean(x, size=5):
    return np.abs(x - box(x, size)) / odd(size)


@image("AdaptiveThresholdMeanMask", "255 where above the box mean less c", block=11, c=2)
def adaptive_mean(x, block=11, c=2):
    return np.where(x > windows(x, odd(block), odd(block), "edge").mean(axis=(3, 4)) - c, 255.0, 0.0)


@image("AdaptiveThresholdGaussianMask", "255 where above the weighted mean less c", block=11, c=2)
def adaptive_gauss(x, block=11, c=2):
    b = odd(block)
    return np.where(x > blur(x, 0.3 * ((b - 1) * 0.5 - 1) + 0.8, "edge", b) - c, 255.0, 0.0)


def _hole(k: int, h: int) -> np.ndarray:
    k, h = odd(k), min(odd(h), odd(k) - 2) if odd(k) > 1 else 0
    m = np.ones((k, k), bool)
    lo = (k - h) // 2
    m[lo : lo + h, lo : lo + h] = False
    return m


@image("MedianFilterHole", "median around a hole", size=7, hole=3)
def hole_median(x, size=7, hole=3):
    return over(x, _hole(size, hole), lambda w: np.median(w, axis=-1))


@image("StdDeviationHole", "population deviation around a hole", size=7, hole=3)
def hole_std(x, size=7, hole=3):
    return over(x, _hole(size, hole), lambda w: w.std(axis=-1))


@image("MeanWithHole", "sum around a hole over the whole window's size", size=7, hole=3)
def hole_mean(x, size=7, hole=3):
    return over(x, _hole(size, hole), lambda w: w.sum(axis=-1), "reflect") / odd(size) ** 2


@image("rmsHole", "root of the variance around a hole", size=7, hole=3)
def hole_rms(x, size=7, hole=3):
    return over(x, _hole(size, hole), lambda w: np.sqrt(np.abs((w**2).mean(axis=-1) - w.mean(axis=-1) ** 2)), "reflect")


@image("Prerejection", "zero what is above alpha times the deviation around it", size=7, hole=3, alpha=1.0)
def prerejection(x, size=7, hole=3, alpha=1.0):
    return np.where(x > alpha * hole_std(x, size, hole), 0.0, x)


# --- images: morphology ----------------------------------------------------------------------------------------------


def element(shape: str, kx: int, ky: int) -> np.ndarray:
    kx, ky = max(1, abs(int(kx))), max(1, abs(int(ky)))
    m = np.ones((ky, kx), bool)
    y, x = np.arange(ky)[:, None] - (ky - 1) // 2, np.arange(kx)[None, :] - (kx - 1) // 2
    if shape == "Cross":
        m = (y == 0) | (x == 0)
    elif shape == "Ellipse":
        half = np.round(kx / 2 * np.sqrt(np.clip(1 - (y / max(ky // 2, 1)) ** 2, 0, 1)))
        m = np.abs(x) <= np.minimum(half, kx // 2)
    return np.broadcast_to(m, (ky, kx)).copy()


def erode(x, m, times=1):
    for _ in range(max(1, int(times))):
        x = over(x, m, lambda w: w.min(axis=-1), "edge")
    return x


def dilate(x, m, times=1):
    for _ in range(max(1, int(times))):
        x = over(x, m, lambda w: w.max(axis=-1), "edge")
    return x


MORPH = {
    "Erosion": lambda x, m, t: erode(x, m, t),
    "Dilate": lambda x, m, t: dilate(x, m, t),
    "Open": lambda x, m, t: dilate(erode(x, m), m),
    "Close": lambda x, m, t: erode(dilate(x, m), m),
    "Gradient": lambda x, m, t: dilate(x, m) - erode(x, m),
    "Tophat": lambda x, m, t: x - dilate(erode(x, m), m),
    "Blackhat": lambda x, m, t: erode(dilate(x, m), m) - x,
}
for _kind, _f in MORPH.items():
    for _shape in ("Rect", "Ellipse", "Cross"):

        def _morph(x, kx=3, ky=3, iterations=1, _f=_f, _shape=_shape):
            return _f(x, element(_shape, kx, ky), iterations)

        register(Op(f"Morph{_kind}{_shape}", 1, {"kx": 3, "ky": 3, "iterations": 1}, kernel=_morph, image=True, doc=f"{_kind.lower()} with a {_shape.lower()} element"))


def reconstruct(seed, mask):
    """Dilation of a seed under a mask until nothing changes."""
    m = np.ones((3, 3), bool)
    while True:
        grown = np.minimum(dilate(seed, m), mask)
        if (grown == seed).all():
            return seed
        seed = grown


@image("ImagePeakFinder", "reconstruction from the border: peaks within are levelled")
def fill_peaks(x):
    seed = np.repeat(np.repeat(x.min(axis=(1, 2), keepdims=True), x.shape[1], 1), x.shape[2], 2).copy()
    seed[:, 0], seed[:, -1], seed[:, :, 0], seed[:, :, -1] = x[:, 0], x[:, -1], x[:, :, 0], x[:, :, -1]
    return reconstruct(seed, x)


@image("RegionalMaxima", "what stands above its surroundings by at most h", h=0.4)
def regional_maxima(x, h=0.4):
    return x - reconstruct(x - h, x)


# --- images: histograms and levels ---------------------------------------------------------------------------------


def _bins(x, n=256):
    lo, hi = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
    return np.clip(((x - lo) / np.where(hi > lo, hi - lo, 1) * n).astype(int), 0, n - 1), lo, hi


def _histogram(b, n=256):
    return np.stack([np.bincount(r.ravel(), minlength=n) for r in b]) if len(b) else np.zeros((0, n))


@image("OtsuBinaryThreshold", "0 above the level that parts the histogram best, the maximum below", maximum=255)
def otsu(x, maximum=255):
    b, _, _ = _bins(x)
    h = _histogram(b).astype(float)
    w = np.cumsum(h, axis=1)
    s = np.cumsum(h * np.arange(256), axis=1)
    with np.errstate(all="ignore"):
        between = np.nan_to_num((s[:, -1:] * w / w[:, -1:] - s) ** 2 / (w * (w[:, -1:] - w)))
    return np.where(b > between.argmax(axis=1)[:, None, None], 0.0, float(maximum))


@image("EqualizeHist", "levels by their cumulative share")
def equalize(x):
    b, _, _ = _bins(x)
    cdf = np.cumsum(_histogram(b), axis=1) / (x.shape[1] * x.shape[2])
    return np.take_along_axis(cdf, b.reshape(len(x), -1), 1).reshape(x.shape)


@image("EqualizeAdaptHist", "equalised within clipped local histograms, tile by tile", clip=0.01)
def clahe(x, clip=0.01):
    out = np.empty_like(x)
    th, tw = max(1, x.shape[1] // 2), max(1, x.shape[2] // 2)
    for i in range(0, x.shape[1], th):
        for j in range(0, x.shape[2], tw):
            t = x[:, i : i + th, j : j + tw]
            b, _, _ = _bins(t)
            h = _histogram(b).astype(float)
            most = np.maximum(clip * t.shape[1] * t.shape[2], 1)
            over_ = np.maximum(h - most, 0).sum(axis=1, keepdims=True)
            cdf = np.cumsum(np.minimum(h, most) + over_ / 256, axis=1) / (t.shape[1] * t.shape[2])
            out[:, i : i + th, j : j + tw] = np.take_along_axis(cdf, b.reshape(len(x), -1), 1).reshape(t.shape)
    return out


@image("EqualizeDisk", "share of the disk around that is not above the pixel", r=3)
def equalize_disk(x, r=3):
    m = disk(int(r))
    return (windows(x, *m.shape, "symmetric")[..., m] <= x[..., None]).mean(axis=-1) * 255


@image("BackgroundSubtraction", "input less the medians of its tiles", tile=4)
def background(x, tile=4):
    out = x.copy()
    for i in range(0, x.shape[1], tile):
        for j in range(0, x.shape[2], tile):
            t = x[:, i : i + tile, j : j + tile]
            out[:, i : i + tile, j : j + tile] = t - np.median(t, axis=(1, 2), keepdims=True)
    return out


# --- images: transforms ------------------------------------------------------------------------------------------------


@image("Cv2DCT", "two-dimensional orthonormal cosine transform")
def dct2(x):
    return _dct_matrix(x.shape[1], 2, True) @ x @ _dct_matrix(x.shape[2], 2, True).T


@image("Cv2iDCT", "inverse of Cv2DCT")
def idct2(x):
    return _dct_matrix(x.shape[1], 2, True).T @ x @ _dct_matrix(x.shape[2], 2, True)


@image("Cv2DFTReal", "real part of the transform")
def dft_real(x):
    return np.fft.fft2(x, axes=(1, 2)).real


@image("Cv2iDFT", "real part of the inverse transform, not scaled")
def idft(x):
    return np.fft.ifft2(x, axes=(1, 2)).real * x.shape[1] * x.shape[2]


@image("MultiplySpectrum", "product of two spectra", inputs=2)
def multiply_spectrum(x, y):
    return np.fft.ifft2(np.fft.fft2(x, axes=(1, 2)) * np.fft.fft2(y, axes=(1, 2)), axes=(1, 2)).real


@image("Correlation", "two-dimensional correlation, same size", inputs=2)
def correlation(x, y):
    h, w = x.shape[1:]
    p = np.pad(x, ((0, 0), (h // 2, h - 1 - h // 2 + (h - 1) % 2 * 0 + h // 2), (w // 2, w - 1 - w // 2 + w // 2)))
    return np.einsum("rhwab,rab->rhw", sliding_window_view(p, (h, w), axis=(1, 2))[:, :h, :w], y)


@image("SpectralFilter", "first less alpha times second, alpha from the correlation of third and fourth", inputs=4)
def spectral_filter(x, ref, px, pref):
    a = (px * pref).sum(axis=(1, 2)) / np.maximum((pref * pref).sum(axis=(1, 2)), 1e-12)
    return x - a[:, None, None] * ref


@image("ImageAlignmentECC", "second shifted by whole pixels to where it correlates best with the first", inputs=2)
def align(x, y):
    cross = np.fft.ifft2(np.fft.fft2(x, axes=(1, 2)) * np.fft.fft2(y, axes=(1, 2)).conj(), axes=(1, 2)).real
    best = cross.reshape(len(x), -1).argmax(axis=1)
    return np.stack([np.roll(y[r], (b // x.shape[2], b % x.shape[2]), (0, 1)) for r, b in enumerate(best)]) if len(x) else y


@image("EdgeDetectionCanny", "edges by two thresholds on thinned gradients", t1=50, t2=150, ksize=3)
def canny(x, t1=50, t2=150, ksize=3):
    t1, t2 = sorted((t1, t2))
    gx, gy = sobel_xy(x, 1, 0, ksize, "edge"), sobel_xy(x, 0, 1, ksize, "edge")
    mag, way = np.hypot(gx, gy), np.round(np.arctan2(gy, gx) / (math.pi / 4)).astype(int) % 4
    p = np.pad(mag, ((0, 0), (1, 1), (1, 1)))
    h, w = x.shape[1:]

    def at(dy, dx):
        return p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    thin = np.zeros(x.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        thin |= (way == k) & (mag > at(-dy, -dx)) & (mag >= at(dy, dx))
    strong, weak = (thin & (mag > t2)).astype(float), (thin & (mag > t1)).astype(float)
    return reconstruct(np.minimum(strong, weak), weak) * 255


def _tensor(x, block, ksize):
    gx, gy = sobel_xy(x, 1, 0, ksize), sobel_xy(x, 0, 1, ksize)
    return box(gx * gx, block), box(gx * gy, block), box(gy * gy, block)


@image("CornerDetectionHarris", "determinant less k squared traces of the gradient tensor", block=3, ksize=3, k=0.04)
def harris(x, block=3, ksize=3, k=0.04):
    a, b, c = _tensor(x, block, ksize)
    return a * c - b * b - k * (a + c) ** 2


@image("CornerDetectionEigen", "least eigenvalue of the gradient tensor", block=3, ksize=3)
def min_eigen(x, block=3, ksize=3):
    a, b, c = _tensor(x, block, ksize)
    return (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
