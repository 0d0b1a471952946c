import math
import random

import numpy as np
import pytest

from arbora.plans.layers import infer, network
from arbora.plans.network import Forward, activation, forward, learn_network, rule_weights

IN = "InputLayer(ARG0)"


def out(tree, x, **options):
    main, modules = network(tree)
    return Forward(modules, **options).run(main, np.asarray(x, float))


def test_dense_by_hand_and_with_trained_weights():
    x = np.array([[1.0, 2.0, 3.0]])
    np.testing.assert_allclose(out(f"DenseLayer(2, {IN})", x), x @ rule_weights((3, 2), 1, 3))
    trained = {1: np.array([[1.0, 0], [0, 1], [1, 1]])}
    assert out(f"DenseLayer(2, reluAct, {IN})", [[1.0, -9.0, 3.0]], weights=trained).tolist() == [[4.0, 0.0]]


@pytest.mark.parametrize(
    "tree, shape",
    [
        (f"Conv2DLayer(3, 5, 2, {IN})", (9, 7, 2)), (f"Conv2DLayer(3, 3, 1, validPad, {IN})", (9, 7, 2)), (f"Conv1DLayer(4, 3, 2, {IN})", (11, 3)), (f"SeparableConv2DLayer(5, 3, {IN})", (6, 6, 2)),
        (f"MaxPoolingLayer2D(3, {IN})", (8, 7, 2)), (f"AveragePoolingLayer1D(2, {IN})", (9, 2)), (f"FlattenLayer(ZeroPadding2DLayer({IN}))", (4, 5, 1)), (f"LSTMLayer(3, {IN})", (6, 2)), (f"GRULayer(3, {IN})", (6, 2)),
        (f"PatchEmbedding(4, 2, {IN})", (8, 6, 3)), (f"ResBlock(4, 3, {IN})", (5, 5, 2)), (f"GlobalMaxPoolingLayer2D(ConvLayer(6, {IN}))", (5, 5, 1)), (f"EmbeddingLayer(3, 20, {IN})", (7,)), (f"DenseLayer(2, DenseLayer(5, tanhAct, {IN}))", (4,)),
    ],
)
def test_inferred_shapes_are_those_computed(tree, shape):
    x = np.random.default_rng(1).normal(size=(2, *shape))
    want, params = infer(network(tree)[0], shape)
    assert out(tree, x).shape == (2, *want) and params >= 0


def test_pools_and_windows_by_brute_force():
    x = np.random.default_rng(2).normal(size=(2, 5, 5, 1))
    got = out(f"MaxPoolingLayer2D(2, {IN})", x)
    want = np.array([[[max(x[n, i, j, 0] for i in range(2 * a, min(2 * a + 2, 5)) for j in range(2 * b, min(2 * b + 2, 5))) for b in range(3)] for a in range(3)] for n in range(2)])
    np.testing.assert_allclose(got[..., 0], want)
    mean = out(f"AveragePoolingLayer2D(2, {IN})", x)
    assert mean[0, 2, 2, 0] == pytest.approx(x[0, 4, 4, 0])  # no padding in a mean


def test_activations():
    x = np.array([-800.0, -1.0, 0.0, 2.0])
    assert activation(x, "reluAct").tolist() == [0, 0, 0, 2] and activation(x, "linear").tolist() == x.tolist()
    assert np.isfinite(activation(x, "sigmoid")).all() and activation(x, "softmax").sum() == pytest.approx(1)
    assert activation(x, "softplus")[0] == pytest.approx(0) and activation(x, "seluAct")[0] == pytest.approx(-1.7580993)
    assert activation(x, "LeakyReLU")[1] == -0.01 and activation(x, "eluAct")[1] == pytest.approx(math.exp(-1) - 1)


def test_rows_without_data_and_bad_trees(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, "b"), (3, [], "c"), (4, [1.0], "d"), (1, [1.0, 2.0], "a")], "row_id long, features array<double>, names string")
    got = forward(df.repartition(3), f"DenseLayer(2, {IN})", shape=(2,)).collect()
    assert sorted((r["row_id"], r["features"] is None, r["names"]) for r in got) == [(1, False, "a"), (1, False, "a"), (2, True, "b"), (3, True, "c"), (4, True, "d")]
    assert forward(df.limit(0), IN).count() == 0
    with pytest.raises(ValueError):
        out("mod_1\nmod_1: DenseLayer(2, mod_1)", [[1.0]])


def test_a_network_learns_what_its_input_does_not_show(spark):
    r = random.Random(3)
    rows = [(i, "test" if i % 4 == 0 else "train", [a, b], float((a > 0) != (b > 0))) for i in range(800) for a, b in [(r.uniform(-1, 1), r.uniform(-1, 1))]]
    df = spark.createDataFrame(rows, "row_id long, split string, features array<double>, target double")
    got = learn_network(df, f"DenseLayer(40, reluAct, DenseLayer(40, tanhAct, {IN}))", maxIter=100).where("split = 'test'").collect()
    assert sum(x["prediction"] == x["target"] for x in got) / len(got) > 0.85 and len(got[0]["features"]) == 3
