import numpy as np
import pytest

import arbora.functions.clustering
import arbora.functions.detection
import arbora.functions.kernels as K
from arbora.functions.registry import OPS
from arbora.operators.dataset import fit_kernel, run_kernel

R = np.random.default_rng(3)
S, M = R.normal(size=(4, 32)), np.floor(R.random((3, 8, 8)) * 255)
ALL = [o for o in OPS.values() if o.kernel]


@pytest.mark.parametrize("op", ALL, ids=lambda o: o.name)
def test_every_kernel_runs_and_is_per_row(op):
    x = M if op.image else S
    extra = [x[::-1], x + 1, x * 2][: op.inputs - 1]
    with np.errstate(all="ignore"):
        fitted = {"fitted": op.fit(x, **op.params).sum(axis=0)} if op.fit else {}
        out = op.kernel(x, *extra, **op.params, **fitted)
        assert len(out) == len(x)
        one = op.kernel(x[:1], *[e[:1] for e in extra], **op.params, **fitted)
        np.testing.assert_allclose(np.ravel(one[0]), np.ravel(out[0]), atol=1e-6)


def test_known_values():
    np.testing.assert_allclose(K.dct(S, 1, 1) @ K._dct_matrix(32, 2, True), S, atol=1e-9)
    np.testing.assert_allclose(K.idct2(K.dct2(M)), M, atol=1e-9)
    np.testing.assert_allclose(K.fft(S), np.abs(np.fft.fft(S)), atol=1e-9)
    np.testing.assert_allclose(K.savgol_taps(5, 2), np.array([-3, 12, 17, 12, -3]) / 35, atol=1e-9)
    line = np.arange(20.0)[None]
    np.testing.assert_allclose(K.savgol(line, 5, 2), line, atol=1e-9)
    flat = np.full((1, 8, 8), 7.0)
    for f in (K.box, K.gaussian_filter, K.median_blur, K.disk_mean, K.bilateral, K.gaussian_xy):
        np.testing.assert_allclose(f(flat), flat, atol=1e-9)
    assert np.abs(K.gradient_magnitude(flat)).max() == 0 and np.abs(K.laplacian(flat)).max() == 0
    assert (K.local_std(M) >= 0).all() and np.isclose(K.dwt(S)[0] @ K.dwt(S)[0], S[0] @ S[0], rtol=1.0)
    p = np.array([[0, 1, 0, 2, 0, 0.1, 0]], float)
    assert K.peaks(p, 0.5)[0].tolist() == [0, 1, 0, 2, 0, 0, 0]
    assert K.kalman(np.full((1, 9), 4.0))[0].tolist() == [4.0] * 9


def test_morphology_by_hand():
    m = np.ones((3, 3), bool)
    want = np.array([[M[0][max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].min() for j in range(8)] for i in range(8)])
    np.testing.assert_array_equal(K.erode(M, m)[0], want)
    assert (K.dilate(M, m) >= M).all() and (K.MORPH["Open"](M, m, 1) <= M).all() and (K.MORPH["Close"](M, m, 1) >= M).all()


def test_objects_and_clusters():
    x = np.zeros((1, 8, 8))
    x[0, 1:3, 1:3] = 9
    x[0, 6, 6] = 9
    assert OPS["LabelObjects"].kernel(x)[0].tolist() == [1.5, 1.5, 6.0, 6.0]
    v = np.array([[0.0, 0.1, 5.0, 5.1, 0.05, 5.05]])
    for n in ("k_means_clustering", "agglomerative_clustering", "birch_clustering"):
        assert OPS[n].kernel(v, k=2)[0].tolist() == [0, 0, 1, 1, 0, 1]
    assert OPS["DBSCANClustering"].kernel(np.array([[0.0] * 6 + [9.0]]))[0].tolist() == [0] * 6 + [-1]


@pytest.mark.parametrize("name", ["ConvolveChannelMerge", "Cv2TemplateMatching", "NormalLikelihood", "CCorrObjectFilter"])
def test_templates_do_not_depend_on_partitions(spark, name):
    images = np.floor(R.random((12, 48)) * 255)
    points = [[[1.0, 2.0], [4.0, 3.0]] if i % 3 else ([[-1.0, -1.0]] if i else None) for i in range(12)]
    df = spark.createDataFrame([(i, images[i].tolist(), points[i], "train" if i < 8 else "test") for i in range(12)], "row_id long, x array<double>, target array<array<double>>, split string")
    train = df.where("split = 'train'")
    runs = [{r["row_id"]: r["out"] for r in run_kernel(df.repartition(n), OPS[name], ["x"], "out", OPS[name].params, width=6, points="target", train=train).collect()} for n in (1, 2, 7)]
    assert len(runs[0]) == 12
    for other in runs[1:]:
        for i in range(12):
            np.testing.assert_allclose(other[i], runs[0][i], atol=1e-9)
    # By hand: the mean chip around the training points, with 8 by 6 images
    pads = np.pad(images.reshape(-1, 8, 6), ((0, 0), (1, 1), (1, 1)), "edge")
    chips = [pads[i, int(r) : int(r) + 3, int(c) : int(c) + 3] for i in range(8) for r, c in points[i] or [] if r >= 0]
    fitted = fit_kernel(train, OPS[name], "x", OPS[name].params, "target", 6)
    if name == "NormalLikelihood":
        np.testing.assert_allclose(fitted, [np.sum(chips), np.sum(np.square(chips)), 9 * len(chips)])
    else:
        np.testing.assert_allclose(fitted[:-1].reshape(3, 3) / fitted[-1], np.mean(chips, axis=0))


def test_run_kernel_keeps_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [], "b"), (3, None, "c"), (1, [3.0], "d")], "id long, x array<double>, out string").repartition(2)
    got = {r["id"]: r["out"] for r in run_kernel(df.drop("out"), OPS["MyCumSum"], ["x"], "out", {}).where("id > 1").collect()}
    assert got == {2: None, 3: None}
    img = run_kernel(df.drop("out"), OPS["HighpassIrst"], ["x"], "out", {}).where("size(x) = 2").first()
    assert img["out"] is None
