import itertools
import math

import numpy as np

from treesum.functions.scalar import chi2_cdf, chi2_quantile, phi, phi_inverse
from treesum.operators.kernel import Chain, Settings, update_jointly, walk
from treesum.operators.slicing import slice_sample


def data(n=40, seed=0):
    r = np.random.default_rng(seed)
    bins = np.stack([r.integers(0, 4, n), r.integers(0, 2, n)], axis=1).astype(np.uint16)
    y = 0.25 * (bins[:, 0] > 1) - 0.1 * bins[:, 1] + 0.1 * r.normal(size=n)
    return bins, np.array([3, 1]), y - y.mean()


def signature(node):
    return "." if node.leaf else f"({node.var}:{node.cut}{signature(node.left)}{signature(node.right)})"


def exact(bins, cuts, y, s, sigma, most):
    """Posterior over all trees, by enumeration."""
    c = Chain(bins, cuts, y, np.ones(len(y)), s, sigma, 1, 0)

    def trees(depth, spans):
        yield None
        if depth < most:
            for v in range(len(cuts)):
                lo, hi = spans[v]
                for k in range(lo, hi + 1):
                    left = [*spans[:v], (lo, k - 1), *spans[v + 1 :]]
                    right = [*spans[:v], (k + 1, hi), *spans[v + 1 :]]
                    for a, b in itertools.product(list(trees(depth + 1, left)), list(trees(depth + 1, right))):
                        yield (v, k, a, b)

    def build(shape, parent):
        from treesum.operators.kernel import Node

        n = Node(parent=parent)
        if shape is not None:
            n.var, n.cut = shape[0], shape[1]
            n.left, n.right = build(shape[2], n), build(shape[3], n)
        return n

    out = {}
    for t in trees(0, [(0, k - 1) for k in cuts]):
        root = build(t, None)
        c.reroute(root, np.arange(len(y)))
        out[signature(root)] = c.log_prior(root) + c.sub_lik(root, y)
    top = max(out.values())
    z = sum(math.exp(v - top) for v in out.values())
    return {k: math.exp(v - top) / z for k, v in out.items()}


def test_chain_visits_trees_by_their_posterior():
    bins, cuts, y = data()
    # at most one split on variable 1 and few on variable 0, so all trees can be listed
    s = Settings(trees=1, base=0.6, power=1.5, k=1.0)
    want = exact(bins, cuts, y, s, 0.2, 4)
    c = Chain(bins, cuts, y, np.ones(len(y)), s, 0.2, 3, 0)
    seen, n = {}, 40_000
    for _ in range(n):
        c.jump(c.roots[0], y)
        k = signature(c.roots[0])
        seen[k] = seen.get(k, 0) + 1
    assert set(seen) <= set(want)
    for k, p in sorted(want.items(), key=lambda x: -x[1])[:15]:
        assert abs(seen.get(k, 0) / n - p) < 0.02 + 0.1 * p, (k, p, seen.get(k, 0) / n)


def friedman(n, seed=99):
    r = np.random.default_rng(seed)
    x = r.random((n, 6))
    f = 10 * np.sin(np.pi * x[:, 0] * x[:, 1]) + 20 * (x[:, 2] - 0.5) ** 2 + 10 * x[:, 3] + 5 * x[:, 4]
    return x, f, f + r.normal(size=n)


def test_friedman_and_invariants():
    x, f, y = friedman(200)
    grid = [np.linspace(0, 1, 52)[1:-1]] * 6
    bins = np.stack([np.searchsorted(g, x[:, j]) for j, g in enumerate(grid)], axis=1).astype(np.uint16)
    lo, span = y.min(), np.ptp(y)
    c = Chain(bins, np.full(6, 50), (y - lo) / span - 0.5, np.ones(200), Settings(trees=30, scale=0.002), 2.5 / span, 7, 0)
    fits = []
    for i in range(250):
        c.sweep()
        if i >= 100:
            fits.append(c.total.copy())
            assert c.valid()
    assert np.allclose(c.total, c.fits.sum(0))
    m = lo + span * (np.mean(fits, axis=0) + 0.5)
    assert np.sqrt(np.mean((m - f) ** 2)) < 0.6 * np.std(f) * 0.5
    counts = c.counts()
    assert counts.sum() == sum(1 for t in c.roots for n in walk(t) if not n.leaf)
    again = Chain(bins, np.full(6, 50), (y - lo) / span - 0.5, np.ones(200), Settings(trees=30, scale=0.002), 2.5 / span, 7, 0)
    for _ in range(250):
        again.sweep()
    assert np.array_equal(again.total, c.total)


def test_probit():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 2))
    p = phi(1.5 * x[:, 0])
    y = (r.random(300) < p).astype(float)
    g = np.linspace(-2, 2, 30)
    c = Chain(np.stack([np.searchsorted(g, x[:, j]) for j in (0, 1)], axis=1).astype(np.uint16), np.array([30, 30]), y, np.ones(300), Settings(trees=20, binary=True, node_scale=3.0), 1.0, 2, 0)
    fits = []
    for i in range(200):
        c.sweep()
        assert ((c.z > 0) == (y == 1)).all()
        if i > 60:
            fits.append(phi(c.total))
    assert np.corrcoef(np.mean(fits, axis=0), p)[0, 1] > 0.9


def test_prior_leaf_sd():
    bins, cuts, y = data()
    c = Chain(bins, cuts, y, np.ones(len(y)), Settings(trees=400, k=2.0), 0.2, 5, 0)
    v = []
    for _ in range(60):
        c.draw_trees_from_prior()
        c.draw_means_from_prior()
        v += [n.mean for t in c.roots for n in walk(t) if n.leaf]
    assert abs(np.std(v) - 0.5 / (2 * math.sqrt(400))) < 3e-4


def test_row_updates_keep_leaves_filled():
    bins, cuts, y = data()
    a, b = (Chain(bins.copy(), cuts, y, np.ones(len(y)), Settings(trees=3), 0.2, s, 0) for s in (1, 2))
    for _ in range(50):
        a.sweep()
        b.sweep()
    new = bins[::-1].copy()
    took = update_jointly([a, b], [new, new])
    assert a.valid() and b.valid()
    for c in (a, b):
        assert np.array_equal(c.bins[took], new[took]) and np.array_equal(c.bins[~took], bins[~took])
        assert np.allclose(c.total, c.fits.sum(0))
    assert not a.set_bins(np.zeros_like(bins), force=False) or all(t.leaf for t in a.roots)
    assert a.set_bins(np.zeros_like(bins), force=True) and a.valid()


def test_functions():
    x = np.linspace(-8, 8, 101)
    assert np.allclose(phi(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=3e-7)
    p = np.linspace(1e-6, 1 - 1e-6, 999)
    assert np.allclose(phi(phi_inverse(p)), p, atol=1e-9)
    assert abs(chi2_quantile(0.95, 3) - 7.814727903) < 1e-6 and abs(chi2_cdf(0.5843743741551833, 3) - 0.1) < 1e-9


def test_slice_sampler():
    r = np.random.default_rng(0)
    x, v = 1.0, []
    for _ in range(6000):
        x = slice_sample(lambda t: 1.5 * math.log(t) - t if t > 0 else -math.inf, x, r)
        v.append(x)
    assert abs(np.mean(v) - 2.5) < 0.12 and abs(np.var(v) - 2.5) < 0.4
