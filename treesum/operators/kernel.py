"""One Markov chain over a sum of trees, in numpy: the work of one task.

Rows are binned once (uint16); a tree keeps each row's leaf and the leaves' means. Random numbers come from Philox streams
keyed by (seed, chain), so results depend on neither partitioning nor the number of cores.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np

from treesum.functions.scalar import phi, phi_inverse


@dataclass
class Settings:
    trees: int = 75
    base: float = 0.95
    power: float = 2.0
    split_probs: np.ndarray | None = None
    k: float = 2.0
    k_chi: tuple[float, float] | None = None
    derived_k: bool = False
    node_scale: float = 0.5
    df: float = 3.0
    scale: float = 0.01
    fixed_sigma: bool = False
    p_birth_death: float = 0.5
    p_swap: float = 0.1
    p_birth: float = 0.5
    hastings: str = "exact"
    binary: bool = False
    prior_trees: bool = False


@dataclass
class Node:
    var: int = -1
    cut: int = -1
    parent: Node | None = None
    left: Node | None = None
    right: Node | None = None
    mean: float = 0.0
    n: int = 0
    rows: np.ndarray | None = field(default=None, repr=False)

    @property
    def leaf(self) -> bool:
        return self.left is None

    @property
    def depth(self) -> int:
        d, n = 0, self.parent
        while n is not None:
            d, n = d + 1, n.parent
        return d


def walk(n: Node):
    yield n
    if not n.leaf:
        yield from walk(n.left)
        yield from walk(n.right)


class Proposal:
    """A move of the subtree at node: places (node, var, cut, left, right) that change, and the log odds of it without the
    likelihood."""

    def __init__(self, node: Node, places: list[tuple]):
        self.node, self.new, self.odds = node, places, 0.0
        self.old = [(x, x.var, x.cut, x.left, x.right) for x, *_ in places]

    def apply(self) -> None:
        for x, *rest in self.new:
            x.var, x.cut, x.left, x.right = rest

    def undo(self) -> None:
        for x, *rest in self.old:
            x.var, x.cut, x.left, x.right = rest


def keyed_uniforms(key: tuple, ids: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each id, the same wherever the row is; by the finaliser of splitmix64 (fixed constants)."""
    h = ids.astype(np.int64).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in key:
            h = h + np.uint64(k & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def group_ids(names: list[str]) -> np.ndarray:
    """Keys of the groups' own random numbers."""
    return np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little", signed=True) for g in names], np.int64)


def group_normals(key: tuple, ids: np.ndarray) -> np.ndarray:
    """A standard normal for each group of a sweep, the same wherever the group is."""
    return phi_inverse(np.maximum(keyed_uniforms((*key, 1), ids), 2.0**-54))


def latents(y: np.ndarray, fit: np.ndarray, weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Normal with mean fit and sd 1 / sqrt(weight), on the side of zero that y says, by the inverse distribution at u."""
    sign, sd = 2 * y - 1, 1 / np.sqrt(weight)
    m = sign * fit / sd
    upper = phi(m)
    x = -phi_inverse(np.maximum(u * upper, 1e-300)) + m
    # far in the tail: exponential steps from the bound
    far = m < -6
    x[far] = -np.log(np.maximum(u[far], 1e-300)) / -m[far]
    return sign * np.maximum(x, 1e-12) * sd


class Chain:
    def __init__(self, bins: np.ndarray, n_cuts: np.ndarray, y: np.ndarray, weight: np.ndarray, settings: Settings, sigma: float, seed: int, chain: int, offset: np.ndarray | None = None, ids: np.ndarray | None = None):
        """bins (rows, variables); y on the scale of the trees, or 0/1 for a binary response; ids: keys of the rows' own
        random numbers."""
        self.s, self.bins, self.n_cuts = settings, bins, np.asarray(n_cuts)
        self.n, self.p = bins.shape
        self.ids = np.arange(self.n) if ids is None else ids
        self.start(settings, sigma, seed, chain)
        self.y, self.w, self.weighted = y.astype(float), weight.astype(float), bool((weight != 1).any())
        self.offset = np.zeros(self.n) if offset is None else offset.astype(float)
        self.fits = np.zeros((settings.trees, self.n))
        self.total = np.zeros(self.n)
        self.z = 2 * self.y - 1 if settings.binary else self.y
        self.place()
        if settings.prior_trees:
            self.draw_trees_from_prior()

    def start(self, settings: Settings, sigma: float, seed: int, chain: int) -> None:
        self.chain, self.accepted, self.sweeps = chain, 0, 0
        self.reseed(seed)
        self.sigma, self.k = (1.0 if settings.binary or settings.fixed_sigma and sigma is None else sigma), settings.k
        self.roots = [Node() for _ in range(settings.trees)]

    def reseed(self, seed: int) -> None:
        self.seed = seed & (2**64 - 1)
        self.r = self.stream(0, 0)

    def stream(self, step: int, sweep: int) -> np.random.Generator:
        """Random numbers of one step of a sweep: tree t has step t + 1, what follows the trees step 0. None are moved by
        what other steps draw, so a chain goes on from its trees, sigma, k and the number of its sweeps."""
        return np.random.Generator(np.random.Philox(key=[self.seed, self.chain], counter=[0, 0, step, sweep]))

    # priors

    def spans(self, node: Node) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(self.p, np.int64), self.n_cuts.astype(np.int64) - 1
        child, up = node, node.parent
        while up is not None:
            if up.left is child:
                hi[up.var] = min(hi[up.var], up.cut - 1)
            else:
                lo[up.var] = max(lo[up.var], up.cut + 1)
            child, up = up, up.parent
        return lo, hi

    def grow_probability(self, node: Node) -> float:
        lo, hi = self.spans(node)
        return self.s.base / (1 + node.depth) ** self.s.power if (lo <= hi).any() else 0.0

    def variable_probabilities(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        p = (lo <= hi) * (np.ones(self.p) if self.s.split_probs is None else self.s.split_probs)
        t = p.sum()
        return p / t if t > 0 else p

    def draw_rule(self, node: Node) -> tuple[int, int]:
        lo, hi = self.spans(node)
        v = int(self.r.choice(self.p, p=self.variable_probabilities(lo, hi)))
        return v, int(self.r.integers(lo[v], hi[v] + 1))

    def log_prior(self, node: Node) -> float:
        """Of the subtree at node; minus infinity if a rule lies outside what its ancestors leave."""
        g = self.grow_probability(node)
        if node.leaf:
            return math.log1p(-g)
        lo, hi = self.spans(node)
        q = self.variable_probabilities(lo, hi)[node.var]
        if not lo[node.var] <= node.cut <= hi[node.var] or q <= 0 or g <= 0:
            return -math.inf
        return math.log(g) + math.log(q) - math.log(hi[node.var] - lo[node.var] + 1) + self.log_prior(node.left) + self.log_prior(node.right)

    # likelihood

    @property
    def precision(self) -> float:
        return (self.k / (self.s.node_scale / math.sqrt(self.s.trees))) ** 2

    def leaf_lik(self, rows: np.ndarray, target: np.ndarray) -> float:
        n = len(rows)
        if not n:
            return -1e7
        t, a, s2 = target[rows], self.precision, self.sigma**2
        if self.weighted:
            w = self.w[rows]
            sw = w.sum()
            m = (w @ t) / sw if sw > 0 else 0.0
            ss = w @ (t - m) ** 2
        else:
            sw, m = float(n), t.mean()
            ss = ((t - m) ** 2).sum()
        b = sw / s2
        return 0.5 * math.log(a / (a + b)) - 0.5 * ss / s2 - 0.5 * a * b * m * m / (a + b)

    def part(self, rows: np.ndarray, var: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        right = self.bins[rows, var] > cut
        return rows[~right], rows[right]

    def reroute(self, node: Node, rows: np.ndarray) -> None:
        node.rows = rows
        if not node.leaf:
            a, b = self.part(rows, node.var, node.cut)
            self.reroute(node.left, a)
            self.reroute(node.right, b)

    def sub_lik(self, node: Node, target: np.ndarray) -> float:
        return sum(self.leaf_lik(x.rows, target) for x in walk(node) if x.leaf)

    # moves

    def birthable(self, root: Node) -> list[Node]:
        return [x for x in walk(root) if x.leaf and self.grow_probability(x) > 0]

    @staticmethod
    def killable(root: Node) -> list[Node]:
        return [x for x in walk(root) if not x.leaf and x.left.leaf and x.right.leaf]

    def birth_probability(self, root: Node, birthable: list[Node]) -> float:
        return 0.0 if not birthable else 1.0 if root.leaf else self.s.p_birth

    def birth_death(self, root: Node) -> Proposal | None:
        can = self.birthable(root)
        pb = self.birth_probability(root, can)
        if self.r.random() < pb:
            node = can[int(self.r.integers(len(can)))]
            g = self.grow_probability(node)
            new = Proposal(node, [(node, *self.draw_rule(node), Node(parent=node), Node(parent=node))])
            new.apply()
            prior = math.log(g) + math.log1p(-self.grow_probability(node.left)) + math.log1p(-self.grow_probability(node.right)) - math.log1p(-g)
            back = (1 - self.birth_probability(root, self.birthable(root))) / len(self.killable(root))
            new.odds = prior + math.log(max(back, 1e-300)) - math.log(pb / len(can))
            new.undo()
            return new
        dead = self.killable(root)
        if not dead:
            return None
        node = dead[int(self.r.integers(len(dead)))]
        prior = math.log1p(-self.grow_probability(node.left)) + math.log1p(-self.grow_probability(node.right))
        new = Proposal(node, [(node, -1, -1, None, None)])
        new.apply()
        g, can = self.grow_probability(node), self.birthable(root)
        back = self.birth_probability(root, can) / max(1, len(can))
        new.odds = math.log1p(-g) - math.log(g) - prior + math.log(max(back, 1e-300)) - math.log((1 - pb) / len(dead))
        new.undo()
        return new

    def good_cuts(self, node: Node, var: int) -> tuple[int, int]:
        """Cuts of var at node that leave the subtree's rules on var valid."""
        lo, hi = self.spans(node)
        lo, hi = int(lo[var]), int(hi[var])
        for x in walk(node.left):
            if not x.leaf and x.var == var:
                lo = max(lo, x.cut + 1)
        for x in walk(node.right):
            if not x.leaf and x.var == var:
                hi = min(hi, x.cut - 1)
        return lo, hi

    def change(self, root: Node) -> Proposal | None:
        inner = [x for x in walk(root) if not x.leaf]
        if not inner:
            return None
        node = inner[int(self.r.integers(len(inner)))]
        lo, hi = self.spans(node)
        q = self.variable_probabilities(lo, hi)
        var = int(self.r.choice(self.p, p=q))
        a, b = self.good_cuts(node, var)
        if a > b:
            return None
        cut = int(self.r.integers(a, b + 1))
        c, d = self.good_cuts(node, node.var)
        forth, back = math.log(q[var] / (b - a + 1)), math.log(q[node.var] / (d - c + 1))
        return self.other_rules(node, [(node, var, cut)], (back - forth) if self.s.hastings == "exact" else 0.0)

    def swap(self, root: Node) -> Proposal | None:
        parents = [x for x in walk(root) if not x.leaf and not (x.left.leaf and x.right.leaf)]
        if not parents:
            return None
        node = parents[int(self.r.integers(len(parents)))]
        inner = [x for x in (node.left, node.right) if not x.leaf]
        both = len(inner) == 2 and (inner[0].var, inner[0].cut) == (inner[1].var, inner[1].cut)
        child = inner[int(self.r.integers(len(inner)))]
        new = [(node, child.var, child.cut)] + [(x, node.var, node.cut) for x in (inner if both else [child])]
        # after the swap the same child must be as likely to be drawn
        return self.other_rules(node, new, 0.0)

    def other_rules(self, node: Node, rules: list[tuple], correction: float) -> Proposal | None:
        """None if the prior rules them out."""
        old = self.log_prior(node)
        new = Proposal(node, [(x, v, c, x.left, x.right) for x, v, c in rules])
        new.apply()
        prior = self.log_prior(node)
        new.undo()
        new.odds = prior - old + correction
        return new if prior > -math.inf else None

    def proposal(self, root: Node) -> Proposal | None:
        """A move, drawn from the tree alone: no data are looked at."""
        u = self.r.random()
        if u < self.s.p_birth_death:
            return self.birth_death(root)
        return self.swap(root) if u < self.s.p_birth_death + self.s.p_swap else self.change(root)

    def jump(self, root: Node, target: np.ndarray) -> None:
        new = self.proposal(root)
        if new is None:
            return
        kept, old = [(x, x.rows) for x in walk(new.node)], self.sub_lik(new.node, target)
        new.apply()
        self.reroute(new.node, new.node.rows)
        if math.log(self.r.random()) < new.odds + self.sub_lik(new.node, target) - old:
            self.accepted += 1
            return
        new.undo()
        for x, rows in kept:
            x.rows = rows

    def draw_leaves(self, root: Node, target: np.ndarray, out: np.ndarray) -> None:
        a, s2 = self.precision, self.sigma**2
        for x in walk(root):
            if x.leaf:
                w = self.w[x.rows]
                b = w.sum() / s2
                m = (w @ target[x.rows]) / s2 / (a + b)
                x.mean = m + self.r.standard_normal() / math.sqrt(a + b)
                out[x.rows] = x.mean

    # sweeps

    def sweep(self) -> None:
        self.sweeps += 1
        if self.s.binary:
            self.draw_latents()
        y = self.z - self.offset if self.s.binary else self.y
        for t, root in enumerate(self.roots):
            self.r = self.stream(t + 1, self.sweeps)
            target = y - (self.total - self.fits[t])
            self.total -= self.fits[t]
            self.jump(root, target)
            self.draw_leaves(root, target, self.fits[t])
            self.total += self.fits[t]
        self.r = self.stream(0, self.sweeps)
        e = y - self.total
        self.draw_scales(self.w @ (e * e))

    def draw_latents(self) -> None:
        self.z = latents(self.y, self.total + self.offset, self.w, keyed_uniforms((self.seed, self.chain, self.sweeps), self.ids))

    def draw_scales(self, squares: float) -> None:
        """sigma from the weighted squares of the residuals, k from the leaves."""
        if not (self.s.binary or self.s.fixed_sigma):
            self.sigma = math.sqrt((self.s.df * self.s.scale + squares) / self.r.chisquare(self.s.df + self.n))
        if self.s.k_chi:
            nu, scale = self.s.k_chi
            m = np.array([x.mean for root in self.roots for x in walk(root) if x.leaf])
            shape = 0.5 * (len(m) + (nu if self.s.derived_k else 2 * nu - 1))
            rate = 0.5 * (self.s.trees * (m @ m) / self.s.node_scale**2 + (0 if math.isinf(scale) else 1 / scale**2))
            self.k = math.sqrt(self.r.gamma(shape, 1 / rate))

    # prior draws

    def grow_from_prior(self) -> None:
        """Trees drawn from the prior, whatever the rows."""

        def grow(x: Node) -> None:
            if self.r.random() < self.grow_probability(x):
                x.var, x.cut = self.draw_rule(x)
                x.left, x.right = Node(parent=x), Node(parent=x)
                grow(x.left)
                grow(x.right)

        self.roots = [Node() for _ in range(self.s.trees)]
        for root in self.roots:
            grow(root)

    def draw_trees_from_prior(self) -> None:
        self.grow_from_prior()
        for root in self.roots:
            self.reroute(root, np.arange(self.n))
            self.collapse(root)
        self.refresh()

    def draw_means_from_prior(self) -> None:
        sd = 1 / math.sqrt(self.precision)
        for root in self.roots:
            for x in walk(root):
                if x.leaf:
                    x.mean = sd * self.r.standard_normal()
        self.refresh()

    def collapse(self, node: Node) -> None:
        """Splits with an empty side go; the mean that stays is the leaves' own, weighted."""
        if node.leaf:
            return
        if not len(node.left.rows) or not len(node.right.rows):
            leaves = [x for x in walk(node) if x.leaf]
            w = np.array([self.w[x.rows].sum() for x in leaves])
            m = np.array([x.mean for x in leaves])
            node.mean = float(w @ m / w.sum()) if w.sum() > 0 else float(m.mean())
            node.left = node.right = None
            node.var = node.cut = -1
            return
        self.collapse(node.left)
        self.collapse(node.right)

    def map_cuts(self, old: list[np.ndarray], new: list[np.ndarray]) -> None:
        """Rules move to the nearest new cut (the higher of two equally near) within what their ancestors leave; where
        nothing is left the split goes, and what stays has the plain mean of its leaves. Rows are not moved."""
        lo, hi = np.zeros(self.p, np.int64), np.array([len(c) for c in new], np.int64)

        def go(x: Node) -> None:
            if x.leaf:
                return
            v = x.var
            a, b = lo[v], hi[v]
            if a >= b:
                x.mean = float(np.mean([y.mean for y in walk(x) if y.leaf]))
                x.left = x.right = None
                x.var = x.cut = -1
                return
            away = np.abs(new[v][a:b] - old[v][x.cut])
            x.cut = int(b - 1 - away[::-1].argmin())
            hi[v] = x.cut
            go(x.left)
            hi[v], lo[v] = b, x.cut + 1
            go(x.right)
            lo[v] = a

        for root in self.roots:
            go(root)
        self.n_cuts = np.array([len(c) for c in new])

    def install(self, trees: list[list[tuple[int, float]]], cuts: list[np.ndarray]) -> None:
        """Trees as (variable, cut or mean) in pre-order take the place of the chain's; rules go to the nearest cuts."""
        self.roots = []
        for nodes in trees:
            rest = iter(nodes)

            def grow(parent: Node | None) -> Node:
                var, value = next(rest)  # noqa: B023
                x = Node(parent=parent)
                if var < 0:
                    x.mean = float(value)
                else:
                    x.var, x.cut = int(var), int(np.abs(cuts[int(var)] - value).argmin())
                    x.left = grow(x)
                    x.right = grow(x)
                return x

            self.roots.append(grow(None))
        self.s.trees = len(self.roots)
        self.place()

    def place(self) -> None:
        """All rows go down all trees anew; fits follow."""
        for root in self.roots:
            self.reroute(root, np.arange(self.n))
        self.fits, self.total = np.zeros((len(self.roots), self.n)), np.zeros(self.n)
        self.refresh()

    def replace_rows(self, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: np.ndarray | None) -> None:
        """Other rows, as many as there are, under the same trees; splits with an empty side go."""
        self.n, self.bins, self.y, self.w = len(bins), bins, y.astype(float), weight.astype(float)
        self.weighted = bool((weight != 1).any())
        self.offset = np.zeros(self.n) if offset is None else offset.astype(float)
        self.z = 2 * self.y - 1 if self.s.binary else self.y
        self.place()
        for root in self.roots:
            self.collapse(root)
        self.refresh()

    def resize(self, trees: int) -> None:
        """Surplus trees go; new ones are single leaves of mean 0."""
        self.roots = self.roots[:trees] + [Node(rows=np.arange(self.n)) for _ in range(trees - len(self.roots))]
        self.s.trees = trees
        self.place()

    def score(self, bins: np.ndarray) -> np.ndarray:
        """Sum of the trees for other rows."""
        out = np.zeros(len(bins))

        def go(x: Node, rows: np.ndarray) -> None:
            if x.leaf:
                out[rows] += x.mean
            else:
                right = bins[rows, x.var] > x.cut
                go(x.left, rows[~right])
                go(x.right, rows[right])

        for root in self.roots:
            go(root, np.arange(len(bins)))
        return out

    def refresh(self) -> None:
        for t, root in enumerate(self.roots):
            for x in walk(root):
                if x.leaf:
                    self.fits[t][x.rows] = x.mean
        self.total = self.fits.sum(0)

    # state in and out

    def trees(self, cuts: list[np.ndarray]) -> list[tuple]:
        """(tree, node, n, var, value) with cuts as values on the predictors' scale."""
        return [(t, i, len(x.rows), x.var, float(x.mean if x.leaf else cuts[x.var][x.cut])) for t, root in enumerate(self.roots) for i, x in enumerate(walk(root))]

    def counts(self) -> np.ndarray:
        out = np.zeros(self.p, np.int64)
        for root in self.roots:
            for x in walk(root):
                if not x.leaf:
                    out[x.var] += 1
        return out

    def valid(self) -> bool:
        return all(len(x.rows) for root in self.roots for x in walk(root) if x.leaf)

    def set_bins(self, bins: np.ndarray, force: bool) -> bool:
        """New predictors of the same rows. Without force the change is refused as a whole if a leaf would be empty; with
        it such splits go."""
        old = self.bins
        self.bins = bins
        for root in self.roots:
            self.reroute(root, np.arange(self.n))
        if not self.valid():
            if not force:
                self.bins = old
                for root in self.roots:
                    self.reroute(root, np.arange(self.n))
                return False
            for root in self.roots:
                self.collapse(root)
        self.refresh()
        return True

    def moves(self, i: int, new: np.ndarray) -> list[tuple[Node, Node]]:
        """(leaf now, leaf after) of row i in the trees where they differ."""
        out = []
        for root in self.roots:
            a = b = root
            while not a.leaf:
                a = a.right if self.bins[i, a.var] > a.cut else a.left
            while not b.leaf:
                b = b.right if new[b.var] > b.cut else b.left
            if a is not b:
                out.append((a, b))
        return out

    def set_row(self, i: int, new: np.ndarray) -> None:
        for a, b in self.moves(i, new):
            a.rows = a.rows[a.rows != i]
            b.rows = np.append(b.rows, i)
            # nodes above keep their rows through reroute at the end of the scan
        self.bins[i] = new

    def update_rows(self, bins: np.ndarray) -> np.ndarray:
        """Rows in random order take their new predictors unless that would empty a leaf; which did."""
        return update_jointly([self], [bins])


def update_jointly(chains: list[Chain], bins: list[np.ndarray], order: np.ndarray | None = None) -> np.ndarray:
    """One scan over the rows, in this order or a random one: a row changes in all chains, or in none if any of them would
    get an empty leaf."""
    first = chains[0]
    ok = np.zeros(first.n, bool)
    for c in chains:
        c.bins = c.bins.copy()
    for i in first.r.permutation(first.n) if order is None else order:
        if all(len(a.rows) > 1 for c, b in zip(chains, bins, strict=True) for a, _ in c.moves(i, b[i])):
            for c, b in zip(chains, bins, strict=True):
                c.set_row(i, b[i])
            ok[i] = True
    for c in chains:
        for root in c.roots:
            c.reroute(root, np.arange(c.n))
        c.refresh()
    return ok
