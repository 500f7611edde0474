"""A small causal self-attention model in numpy: forward, gradients, Adam.

Made for few passes over memory on one thread:

* The last channel of every state is 1.  It carries all biases, and the attention weights' sums come out
  of the product with the states; weights that would change it are held at 0.
* One matrix compares states with states, and one brings the attended states in.
* The output is a tree of two levels: a softmax over branches, then one over the leaves of the target's
  branch.  A class is numbered branch * leaves + leaf.  Rows are sorted by branch, so that each branch is
  one matrix product.
* exp() is taken without a search for the greatest score; the sums tell if that overflowed, and only
  then it is repeated with limited scores.
"""

from __future__ import annotations

import ctypes

import numpy as np

#: Width (with the channel of 1) and context of the model; branches of the output and leaves of each.
WIDTH, CONTEXT = 16, 32
BRANCHES, LEAVES = 16, 48

Params = dict[str, np.ndarray]
#: Weights whose last column is fixed.
_FIXED = ("embed", "place", "join")


def new_params(n_inputs: int, class_counts: np.ndarray, seed: int = 7) -> Params:
    """Random weights; the output biases start at the log frequencies of class_counts (branches, leaves)."""
    rng = np.random.default_rng(seed)
    d = WIDTH
    branches, leaves = class_counts.shape

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {
        "embed": normal(n_inputs, d, scale=0.3),
        "place": normal(CONTEXT, d, scale=0.1),
        "look": normal(d, d, scale=d**-0.5),
        "join": normal(d, d, scale=0.3 * d**-0.5),
        "branch": normal(d, branches, scale=0.1 * d**-0.5),
        "leaf": normal(branches, d, leaves, scale=0.1 * d**-0.5),
    }
    for name in _FIXED:
        p[name][:, -1] = name == "embed"
    counts = class_counts + 0.5
    p["branch"][-1] = np.log(counts.sum(axis=1) / counts.sum())
    p["leaf"][:, -1] = np.log(counts / counts.sum(axis=1, keepdims=True))
    return p


_PAST = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
_ONES = np.ones(max(BRANCHES, LEAVES), np.float32)
#: Limit of scores before exp(), and the least of what comes out.
_MOST, _LEAST = np.float32(60), np.float32(1e-30)


def _exp(scores, total) -> tuple[np.ndarray, np.ndarray]:
    """e = exp(scores()) and total(e); of limited scores if that isn't finite."""
    with np.errstate(over="ignore", invalid="ignore"):
        e = scores()
        np.exp(e, out=e)
        found = total(e)
    if not np.isfinite(found).all():
        e = np.minimum(scores(), _MOST)
        np.exp(e, out=e)
        found = total(e)
    return e, found


def hidden(p: Params, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Last hidden state at each position (rows) of inputs (windows, CONTEXT), and what gradients need."""
    h0 = p["embed"].take(x.reshape(-1), axis=0).reshape(*x.shape, WIDTH)
    h0 += p["place"]
    flat = h0.reshape(-1, WIDTH)
    q = (flat @ p["look"]).reshape(h0.shape)

    def attended(e):
        e *= _PAST
        return e @ h0

    e, c = _exp(lambda: q @ h0.transpose(0, 2, 1), attended)
    c = c.reshape(-1, WIDTH)
    share = 1 / (c[:, -1:] + _LEAST)
    c *= share
    h1 = c @ p["join"]
    h1 += flat
    return h1, (h0, q, e, share, c)


def _sums(e: np.ndarray) -> np.ndarray:
    return e @ _ONES[: e.shape[1]] + _LEAST


def _by_branch(target: np.ndarray, branches: int, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Order of rows by branch, branch and leaf in that order, and the rows of each branch that has any."""
    branch = target // leaves
    order = np.argsort(branch.astype(np.uint16), kind="stable")
    branch = branch.take(order)
    cut = np.searchsorted(branch, np.arange(branches + 1)).tolist()
    return order, branch, target.take(order) - branch * leaves, [(j, slice(a, b)) for j, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]


def _outputs(p: Params, h: np.ndarray, parts: list[tuple[int, slice]]):
    """exp() of scores and their sums: of all branches, and of the leaves of each row's branch; rows in order of branches."""

    def leaves():
        z = np.empty((len(h), p["leaf"].shape[2]), h.dtype)
        for j, part in parts:
            np.matmul(h[part], p["leaf"][j], out=z[part])
        return z

    return *_exp(lambda: h @ p["branch"], _sums), *_exp(leaves, _sums)


def log_probs(p: Params, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target class; h: (n, WIDTH)."""
    if not len(h):
        return np.zeros(0, np.float32)
    branches, _, leaves = p["leaf"].shape
    order, branch, leaf, parts = _by_branch(target, branches, leaves)
    first, first_sum, second, second_sum = _outputs(p, h.take(order, axis=0), parts)
    at = np.arange(len(order))
    found = first[at, branch] / first_sum
    found *= second[at, leaf] / second_sum
    out = np.empty_like(found)
    out[order] = np.log(found + _LEAST)
    return out


def gradients(p: Params, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Params:
    """Gradients of the mean negative log probability over held positions; x, y, held: (windows, CONTEXT)."""
    h1, (h0, q, e, share, c) = hidden(p, x)
    rows = np.flatnonzero(held.reshape(-1))
    branches, _, leaves = p["leaf"].shape
    order, branch, leaf, parts = _by_branch(y.reshape(-1).take(rows), branches, leaves)
    rows = rows.take(order)
    top = h1.take(rows, axis=0)
    first, first_sum, second, second_sum = _outputs(p, top, parts)
    n, at = len(rows), np.arange(len(rows))
    for z, total, target in ((first, first_sum, branch), (second, second_sum, leaf)):
        z *= (np.float32(1 / n) / total)[:, None]
        z[at, target] -= np.float32(1 / n)
    g: Params = {"branch": top.T @ first, "leaf": np.zeros_like(p["leaf"])}
    d_top = first @ p["branch"].T
    for j, part in parts:
        np.matmul(top[part].T, second[part], out=g["leaf"][j])
        d_top[part] += second[part] @ p["leaf"][j].T
    d1 = np.zeros_like(h1)
    d1[rows] = d_top
    g["join"] = c.T @ d1
    dc = d1 @ p["join"].T
    dc *= share
    # The channel of 1 takes off what each weight loses as the sum of weights is 1.
    dc[:, -1] = -np.einsum("ij,ij->i", dc[:, :-1], c[:, :-1])
    dc = dc.reshape(h0.shape)
    ds = dc @ h0.transpose(0, 2, 1)
    ds *= e
    dq = (ds @ h0).reshape(-1, WIDTH)
    g["look"] = h0.reshape(-1, WIDTH).T @ dq
    d0 = d1
    d0 += dq @ p["look"].T
    d0 += (e.transpose(0, 2, 1) @ dc).reshape(-1, WIDTH)
    d0 += (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
    g["place"] = d0.reshape(len(x), -1).sum(axis=0).reshape(CONTEXT, WIDTH)
    g["embed"] = np.zeros_like(p["embed"])
    inputs = x.reshape(-1)
    order = np.argsort(inputs.astype(np.uint16), kind="stable")
    inputs = inputs.take(order)
    begin = np.flatnonzero(np.diff(inputs, prepend=-1))
    g["embed"][inputs[begin]] = np.add.reduceat(d0.take(order, axis=0), begin, axis=0)
    for name in _FIXED:
        g[name][:, -1] = 0
    return g


def keep_memory() -> None:
    """Tell the C library to keep freed memory, as arrays of one size come and go; without it pages are cleared each time."""
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {n: np.zeros_like(v) for n, v in p.items()}
        self.v = {n: np.zeros_like(v) for n, v in p.items()}

    def step(self, g: Params) -> None:
        """One step; the arrays of g are used up."""
        self.t += 1
        norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for n, x in g.items():
            m, v = self.m[n], self.v[n]
            x *= scale * np.float32(0.1)
            m *= np.float32(0.9)
            m += x
            x *= x
            x *= np.float32(0.1)  # 0.001 of the square, as x holds a tenth
            v *= np.float32(0.999)
            v += x
            np.sqrt(v, out=x)
            x += np.float32(1e-8)
            np.divide(m, x, out=x)
            x *= rate
            self.p[n] -= x


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[n].reshape(-1) for n in sorted(p)])


def unpack(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for n in sorted(like):
        size = like[n].size
        out[n] = flat[at : at + size].reshape(like[n].shape).astype(np.float32)
        at += size
    return out
