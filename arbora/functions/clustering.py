"""Clustering of the samples within one row: each kernel gives the row's samples their labels, from 0."""

from __future__ import annotations

import numpy as np

from arbora.functions.kernels import signal


def _renumber(labels: np.ndarray) -> np.ndarray:
    """Labels in order of first appearance; -1 stays."""
    seen: dict = {}
    return np.array([-1 if v < 0 else seen.setdefault(v, len(seen)) for v in labels.tolist()], float)


def _kmeans(p: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    k = max(1, min(k, len(np.unique(p, axis=0))))
    order = np.lexsort(p.T[::-1])
    centre = p[order[np.linspace(0, len(p) - 1, k).astype(int)]].astype(float)
    label = None
    for _ in range(rounds):
        new = ((p[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        if label is not None and (new == label).all():
            break
        label = new
        for c in range(k):
            if (label == c).any():
                centre[c] = p[label == c].mean(axis=0)
    return label


def _rows(x, f):
    return [_renumber(np.asarray(f(r[:, None]))) for r in x]


@signal("k_means_clustering", "k-means of the samples, started from even ranks", k=3)
def k_means(x, k=3):
    return _rows(x, lambda p: _kmeans(p, max(1, int(k))))


@signal("DBSCANClustering", "density clusters of the samples; -1 is noise", eps=0.05, p=2)
def dbscan(x, eps=0.05, p=2, least=5):
    def one(v):
        near = (np.abs(v[:, None] - v[None]) ** p).sum(axis=2) ** (1 / p) <= eps
        core = near.sum(axis=1) >= least
        label = np.where(core, np.arange(len(v)), -1)
        while True:
            spread = np.where(near & core[None] & core[:, None], label[None], len(v)).min(axis=1)
            new = np.where(core, np.minimum(label, spread), -1)
            if (new == label).all():
                break
            label = new
        edge = np.where(near & core[None], label[None], len(v)).min(axis=1)
        return np.where(core, label, np.where(edge < len(v), edge, -1))

    return _rows(x, one)


@signal("MeanShiftClustering", "samples move to the mean around them until they rest", quantile=0.3)
def mean_shift(x, quantile=0.3):
    def one(v):
        d = np.abs(v - v.T)
        width = np.quantile(d, quantile) + 1e-12
        m = v[:, 0].copy()
        for _ in range(100):
            w = np.abs(m[:, None] - v[:, 0][None]) <= width
            new = (w * v[:, 0][None]).sum(axis=1) / np.maximum(w.sum(axis=1), 1)
            if np.abs(new - m).max() < 1e-3 * width:
                break
            m = new
        order = np.argsort(m, kind="stable")
        group = np.zeros(len(m), int)
        group[order] = np.r_[0, np.cumsum(np.diff(m[order]) > width / 2)]
        return group

    return _rows(x, one)


@signal("agglomerative_clustering", "joining of the two groups that raise the spread least, until k are left", k=2)
def agglomerative(x, k=2):
    def one(v):
        # In one dimension only neighbouring groups can be the best to join.
        order = np.argsort(v[:, 0], kind="stable")
        groups = [[i] for i in order]
        mean, size = v[order, 0].astype(float).tolist(), [1] * len(v)
        while len(groups) > max(1, int(k)):
            cost = [(mean[j] - mean[j + 1]) ** 2 * size[j] * size[j + 1] / (size[j] + size[j + 1]) for j in range(len(groups) - 1)]
            j = int(np.argmin(cost))
            mean[j] = (mean[j] * size[j] + mean[j + 1] * size[j + 1]) / (size[j] + size[j + 1])
            size[j] += size[j + 1]
            groups[j] = groups[j] + groups.pop(j + 1)
            mean.pop(j + 1)
            size.pop(j + 1)
        out = np.zeros(len(v), int)
        for g, members in enumerate(groups):
            out[members] = g
        return out

    return _rows(x, one)


@signal("birch_clustering", "samples gathered in order within a radius, the gatherings then clustered", threshold=0.05, branching=50, k=3)
def birch(x, threshold=0.05, branching=50, k=3):
    def one(v):
        centre, count, label = [], [], []
        for s in v[:, 0]:
            d = [abs(s - c) for c in centre]
            if d and min(d) <= threshold:
                j = int(np.argmin(d))
                count[j] += 1
                centre[j] += (s - centre[j]) / count[j]
            else:
                j = len(centre)
                centre.append(float(s))
                count.append(1)
            label.append(j)
        return _kmeans(np.array(centre)[:, None], max(1, int(k)))[label]

    return _rows(x, one)


@signal("SpectralClustering", "k-means in the space of the leading vectors of the similarity graph", k=3, gamma=1.0)
def spectral(x, k=3, gamma=1.0):
    def one(v):
        a = np.exp(-gamma * (v - v.T) ** 2 / (v.var() + 1e-12))
        d = 1 / np.sqrt(a.sum(axis=1))
        vec = np.linalg.eigh(a * d[:, None] * d[None])[1][:, -max(1, int(k)) :]
        return _kmeans(vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12), max(1, int(k)))

    return _rows(x, one)


@signal("AffinityPropagationClustering", "samples choose exemplars by messages", damping=0.7)
def affinity(x, damping=0.7):
    damping = min(max(float(damping), 0.5), 0.99999)

    def one(v):
        n = len(v)
        s = -((v - v.T) ** 2) - 1e-9 * np.arange(n)[None]
        np.fill_diagonal(s, np.median(s))
        r, a = np.zeros((n, n)), np.zeros((n, n))
        for _ in range(100):
            t = a + s
            best = t.argmax(axis=1)
            first = t[np.arange(n), best]
            t[np.arange(n), best] = -np.inf
            new = s - first[:, None]
            new[np.arange(n), best] = s[np.arange(n), best] - t.max(axis=1)
            r = damping * r + (1 - damping) * new
            p = np.maximum(r, 0)
            np.fill_diagonal(p, r.diagonal())
            new = p.sum(axis=0)[None] - p
            own = new.diagonal().copy()
            new = np.minimum(new, 0)
            np.fill_diagonal(new, own)
            a = damping * a + (1 - damping) * new
        pick = np.flatnonzero((a + r).diagonal() > 0)
        return pick[s[:, pick].argmax(axis=1)] if len(pick) else np.zeros(n, int)

    return _rows(x, one)
