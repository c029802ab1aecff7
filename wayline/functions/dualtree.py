"""Vectorised dual-tree search between two point sets, and between points and polygons (numpy kernels)."""

from __future__ import annotations

import numpy as np

LEAF = 16


def _bits(v: np.ndarray) -> np.ndarray:
    """Spread the low 20 bits of v three apart."""
    v = v.astype(np.uint64) & np.uint64(0xFFFFF)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


class Tree:
    """Bounding-box tree over points of any dimension up to 3: points in Morton order, boxes of 16 points, each level joins two boxes."""

    def __init__(self, xyz: np.ndarray):
        lo, hi = xyz.min(axis=0), xyz.max(axis=0)
        cell = ((xyz - lo) / np.maximum((hi - lo).max(), 1e-9) * 0xFFFFF).astype(np.int64)
        code = np.zeros(len(xyz), np.uint64)
        for k in range(xyz.shape[1]):
            code |= _bits(cell[:, k]) << np.uint64(k)
        self.order = np.argsort(code, kind="stable")
        self.xyz = xyz[self.order]
        starts = np.arange(0, len(xyz), LEAF)
        lows, highs = [np.minimum.reduceat(self.xyz, starts)], [np.maximum.reduceat(self.xyz, starts)]
        while len(lows[-1]) > 1:
            s = np.arange(0, len(lows[-1]), 2)
            lows.append(np.minimum.reduceat(lows[-1], s))
            highs.append(np.maximum.reduceat(highs[-1], s))
        self.lows, self.highs = lows, highs  # level 0: leaves

    @property
    def top(self) -> int:
        return len(self.lows) - 1

    def span(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end position of the points below nodes."""
        width = LEAF << level
        return node * width, np.minimum((node + 1) * width, len(self.xyz))


def _expand(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions of ranges a0..a1 and b0..b1, row by row."""
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a0[row] + k // nb[row], b0[row] + k % nb[row]


def near_pairs(a: np.ndarray, b: np.ndarray, radius: float, chunk: int = 2_000_000):
    """Yields arrays (i, j) of rows of a and b at most ``radius`` apart (straight line).

    Pairs of boxes are compared level by level: impossible pairs are dropped, pairs that are certainly near are taken whole, and the
    uncertain are split until leaves, whose points are compared one by one.
    """
    if not len(a) or not len(b):
        return
    ta, tb = Tree(a), Tree(b)
    r2 = radius * radius
    stack = [(ta.top, tb.top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, u, v = stack.pop()
        if len(u) > 50_000 and (la or lb):
            half = len(u) // 2
            stack += [(la, lb, u[:half], v[:half]), (la, lb, u[half:], v[half:])]
            continue
        al, ah, bl, bh = ta.lows[la][u], ta.highs[la][u], tb.lows[lb][v], tb.highs[lb][v]
        gap = np.maximum(0, np.maximum(al - bh, bl - ah))
        keep = (gap * gap).sum(axis=1) <= r2
        reach = np.maximum(np.abs(ah - bl), np.abs(bh - al))
        sure = keep & ((reach * reach).sum(axis=1) <= r2 * (1 - 1e-9))
        if sure.any():
            for s in range(0, int(sure.sum()), 4096):
                us, vs = u[sure][s : s + 4096], v[sure][s : s + 4096]
                i, j = _expand(*ta.span(la, us), *tb.span(lb, vs))
                yield ta.order[i], tb.order[j]
        u, v = u[keep & ~sure], v[keep & ~sure]
        if not len(u):
            continue
        if la == 0 and lb == 0:
            step = max(1, chunk // (LEAF * LEAF))
            for s in range(0, len(u), step):
                i, j = _expand(*ta.span(0, u[s : s + step]), *tb.span(0, v[s : s + step]))
                d = ta.xyz[i] - tb.xyz[j]
                hit = (d * d).sum(axis=1) <= r2
                if hit.any():
                    yield ta.order[i[hit]], tb.order[j[hit]]
            continue
        if la >= lb:
            n, la = len(ta.lows[la - 1]), la - 1
            u, v = np.concatenate([2 * u, 2 * u + 1]), np.concatenate([v, v])
            ok = u < n
        else:
            n, lb = len(tb.lows[lb - 1]), lb - 1
            u, v = np.concatenate([u, u]), np.concatenate([2 * v, 2 * v + 1])
            ok = v < n
        stack.append((la, lb, u[ok], v[ok]))


def inside_rings(x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd rule: whether points lie inside the rings whose edges (x1, y1, x2, y2) are given."""
    out = np.zeros(len(x), bool)
    for s in range(0, len(x), max(1, 2_000_000 // max(1, len(edges)))):
        e = slice(s, s + max(1, 2_000_000 // max(1, len(edges))))
        px, py = x[e, None], y[e, None]
        x1, y1, x2, y2 = (edges[None, :, k] for k in range(4))
        cross = (y1 > py) != (y2 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
        out[e] = (cross & left).sum(axis=1) % 2 == 1
    return out


def points_in_polygons(xy: np.ndarray, polygons: list[np.ndarray]):
    """Yields (i, k): row i of xy lies inside polygon k. A polygon is its edges (x1, y1, x2, y2), holes included.

    Dual tree: the point tree against each polygon's box and edges. A box of points outside the polygon's box is dropped; one that no
    edge touches lies wholly inside or outside as its centre does; the rest is split down to leaves and tested point by point.
    """
    if not len(xy) or not polygons:
        return
    t = Tree(xy)
    boxes = np.array([[e[:, [0, 2]].min(), e[:, [1, 3]].min(), e[:, [0, 2]].max(), e[:, [1, 3]].max()] if len(e) else [1, 1, 0, 0] for e in polygons])
    # box against box, for all polygons at once, down to the level where boxes of points are about as small as polygons
    for k, e in enumerate(polygons):
        if not len(e):
            continue
        node, level = np.zeros(1, np.int64), t.top
        while len(node):
            lo, hi = t.lows[level][node], t.highs[level][node]
            near = (lo[:, 0] <= boxes[k, 2]) & (hi[:, 0] >= boxes[k, 0]) & (lo[:, 1] <= boxes[k, 3]) & (hi[:, 1] >= boxes[k, 1])
            node, lo, hi = node[near], lo[near], hi[near]
            if not len(node):
                break
            touched = np.zeros(len(node), bool)
            step = max(1, 1_000_000 // len(e))
            for s in range(0, len(node), step):
                l, h = lo[s : s + step, None, :], hi[s : s + step, None, :]
                touched[s : s + step] = (
                    (np.minimum(e[None, :, 0], e[None, :, 2]) <= h[:, :, 0]) & (np.maximum(e[None, :, 0], e[None, :, 2]) >= l[:, :, 0])
                    & (np.minimum(e[None, :, 1], e[None, :, 3]) <= h[:, :, 1]) & (np.maximum(e[None, :, 1], e[None, :, 3]) >= l[:, :, 1])
                ).any(axis=1)
            whole = node[~touched]
            if len(whole):
                c = (lo[~touched] + hi[~touched]) / 2
                whole = whole[inside_rings(c[:, 0], c[:, 1], e)]
                if len(whole):
                    i, _ = _expand(*t.span(level, whole), np.zeros(len(whole), np.int64), np.ones(len(whole), np.int64))
                    yield t.order[i], np.full(len(i), k)
            node = node[touched]
            if level == 0:
                if len(node):
                    i, _ = _expand(*t.span(0, node), np.zeros(len(node), np.int64), np.ones(len(node), np.int64))
                    i = i[inside_rings(t.xyz[i, 0], t.xyz[i, 1], e)]
                    yield t.order[i], np.full(len(i), k)
                break
            level -= 1
            node = np.concatenate([2 * node, 2 * node + 1])
            node = node[node < len(t.lows[level])]
