"""Kalman smoothing, two-state decoding and smallest circles, vectorised over many short pieces (numpy kernels)."""

from __future__ import annotations

import numpy as np

from wayline.functions.geometry import EARTH_RADIUS_M

#: Standard deviation of a fix (m) and spectral density of the acceleration noise (m2/s3).
FIX_SD_M = 8.0
ACCELERATION = 0.5
BLOCK, OVERLAP = 192, 32
STAY, MOVE = 0, 1


def metres(lon1, lat1, lon2, lat2):
    """Great-circle metres between arrays of points."""
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def plane(lon, lat, lon0, lat0):
    """Metres east and north of a near origin."""
    d = (lon - lon0 + 180.0) % 360.0 - 180.0
    return EARTH_RADIUS_M * np.radians(d) * np.cos(np.radians((lat + lat0) / 2)), EARTH_RADIUS_M * np.radians(lat - lat0)


def blocks(starts: np.ndarray, ends: np.ndarray):
    """Cut sequences [start, end) into overlapping blocks: (first, end, core first, core end), sorted by length."""
    n = np.maximum(1, -(-(ends - starts) // BLOCK))
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    core0 = starts[row] + k * BLOCK
    core1 = np.minimum(core0 + BLOCK, ends[row])
    b0, b1 = np.maximum(core0 - OVERLAP, starts[row]), np.minimum(core1 + OVERLAP, ends[row])
    o = np.argsort(b1 - b0, kind="stable")
    return b0[o], b1[o], core0[o], core1[o]


def smooth_and_decode(t_s: np.ndarray, lon: np.ndarray, lat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Smoothed lon, lat, speed, and for every ping the decoded state of the interval that leads to it (STAY or MOVE; MOVE for a first ping).

    A constant-velocity Kalman filter with backward (RTS) pass, then Viterbi decoding of two states whose emissions are the smoothed
    displacements: half-normal when staying, exponential with a mean of 10 m/s when moving. Both run over all blocks at once.
    """
    out_lon, out_lat, out_v, state = lon.copy(), lat.copy(), np.zeros(len(lon)), np.full(len(lon), MOVE, np.int8)
    b0, b1, c0, c1 = blocks(starts, ends)
    at = 0
    while at < len(b0):
        # as many blocks as are at most a third longer than the first of them, in bounded memory
        first = max(8, int(b1[at] - b0[at]))
        stop = int(np.searchsorted(b1 - b0, first * 4 // 3, side="right"))
        stop = min(max(stop, at + 1), at + max(1, 400_000 // (first * 4 // 3)))
        f, e = b0[at:stop], b1[at:stop]
        width = int((e - f).max())
        idx = np.minimum(f[:, None] + np.arange(width)[None, :], (e - 1)[:, None])  # beyond the end: the last ping again
        real = f[:, None] + np.arange(width)[None, :] < e[:, None]
        _block(idx, real, t_s, lon, lat, c0[at:stop], c1[at:stop], out_lon, out_lat, out_v, state)
        at = stop
    return out_lon, out_lat, out_v, state


def _block(idx, real, t_s, lon, lat, c0, c1, out_lon, out_lat, out_v, state):
    n, width = idx.shape
    lon0, lat0 = lon[idx[:, :1]], lat[idx[:, :1]]
    x, y = plane(lon[idx], lat[idx], lon0, lat0)
    tt = t_s[idx]
    dt = np.diff(tt, axis=1, prepend=tt[:, :1])
    r = FIX_SD_M**2
    fp, pp = np.empty((5, width, n)), np.empty((5, width, n))  # filtered and predicted: x, vx, p11, p12, p22; y apart
    fy, py = np.empty((2, width, n)), np.empty((2, width, n))
    mx, vx, my, vy = x[:, 0].copy(), np.zeros(n), y[:, 0].copy(), np.zeros(n)
    p11, p12, p22 = np.full(n, r), np.zeros(n), np.full(n, 400.0)
    for k in range(width):
        if k:
            d = dt[:, k]
            q = ACCELERATION * np.minimum(d, 600.0)
            mx, my = mx + d * vx, my + d * vy
            p11 = p11 + 2 * d * p12 + d * d * p22 + q * d * d / 3 + 1e-6
            p12 = p12 + d * p22 + q * d / 2
            p22 = p22 + q + 1e-6
        pp[0, k], pp[1, k], pp[2, k], pp[3, k], pp[4, k], py[0, k], py[1, k] = mx, vx, p11, p12, p22, my, vy
        s = np.where(real[:, k], p11 + r, np.inf)
        g1, g2 = p11 / s, p12 / s
        ex, ey = x[:, k] - mx, y[:, k] - my
        mx, vx, my, vy = mx + g1 * ex, vx + g2 * ex, my + g1 * ey, vy + g2 * ey
        p22 = p22 - g2 * p12
        p12 = (1 - g1) * p12
        p11 = (1 - g1) * p11
        fp[0, k], fp[1, k], fp[2, k], fp[3, k], fp[4, k], fy[0, k], fy[1, k] = mx, vx, p11, p12, p22, my, vy
    sx, sy, sv = np.empty((width, n)), np.empty((width, n)), np.empty((width, n))
    sx[-1], sy[-1], sv[-1] = mx, my, np.hypot(vx, vy)
    for k in range(width - 2, -1, -1):
        d = dt[:, k + 1]
        a11, a12, a22 = fp[2, k], fp[3, k], fp[4, k]
        b11, b12 = a11 + d * a12, a12
        b21, b22 = a12 + d * a22, a22  # rows of P F'
        det = pp[2, k + 1] * pp[4, k + 1] - pp[3, k + 1] ** 2
        i11, i12, i22 = pp[4, k + 1] / det, -pp[3, k + 1] / det, pp[2, k + 1] / det
        g11, g12 = b11 * i11 + b12 * i12, b11 * i12 + b12 * i22
        g21, g22 = b21 * i11 + b22 * i12, b21 * i12 + b22 * i22
        ex, ev = mx - pp[0, k + 1], vx - pp[1, k + 1]
        ey, ew = my - py[0, k + 1], vy - py[1, k + 1]
        mx, vx = fp[0, k] + g11 * ex + g12 * ev, fp[1, k] + g21 * ex + g22 * ev
        my, vy = fy[0, k] + g11 * ey + g12 * ew, fy[1, k] + g21 * ey + g22 * ew
        sx[k], sy[k], sv[k] = mx, my, np.hypot(vx, vy)
    # two states; interval k leads to ping k
    step = np.hypot(np.diff(sx, axis=0), np.diff(sy, axis=0))
    gap = np.maximum(dt.T[1:], 0.05)
    sd = 5.0 + 10.0 * np.minimum(1.0, gap / 30.0)
    stay = -0.5 * (step / sd) ** 2 - np.log(1.2533 * sd)
    move = -step / (10.0 * gap) - np.log(10.0 * gap)
    # the state may well change during a long interval
    p = 0.05 + 0.45 * (1 - np.exp(-gap / 120.0))
    log_keep, log_change = np.log(1 - p), np.log(p)
    back = np.zeros((2, width, n), bool)  # True: came from the other state
    a, b = np.zeros(n), np.zeros(n)
    for k in range(width - 1):
        ok, keep, change = real[:, k + 1], log_keep[k], log_change[k]
        from_b, from_a = b + change > a + keep, a + change > b + keep
        back[0, k + 1], back[1, k + 1] = from_b & ok, from_a & ok
        na = np.where(from_b, b + change, a + keep) + stay[k]
        nb = np.where(from_a, a + change, b + keep) + move[k]
        a, b = np.where(ok, na, a), np.where(ok, nb, b)
    path = np.empty((width, n), np.int8)
    s = (b > a).astype(np.int8)
    for k in range(width - 1, -1, -1):
        path[k] = s
        s = np.where(np.where(s == 0, back[0, k], back[1, k]), 1 - s, s).astype(np.int8)
    path[0] = MOVE
    cols = np.arange(width)[:, None]
    pos = idx.T
    core = real.T & (pos >= c0[None, :]) & (pos < c1[None, :]) & (cols >= 0)
    w = pos[core]
    out_v[w], state[w] = sv[core], path[core]
    lat_new = lat0[:, 0][None, :] + np.degrees(sy / EARTH_RADIUS_M)
    lon_new = lon0[:, 0][None, :] + np.degrees(sx / (EARTH_RADIUS_M * np.cos(np.radians((lat_new + lat0[:, 0][None, :]) / 2))))
    out_lat[w] = lat_new[core]
    out_lon[w] = lon_new[core]


def _through(p: list[tuple[float, float]]) -> tuple[float, float, float]:
    """Circle through 2 (as diameter) or 3 points."""
    if len(p) == 1:
        return p[0][0], p[0][1], 0.0
    (ax, ay), (bx, by) = p[0], p[1]
    if len(p) == 2:
        return (ax + bx) / 2, (ay + by) / 2, ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 / 2
    cx, cy = p[2]
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(d) < 1e-12:
        return 0.0, 0.0, float("inf")
    ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
    uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
    return ux, uy, ((ax - ux) ** 2 + (ay - uy) ** 2) ** 0.5


def smallest_circle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the smallest circle round points: the farthest point joins the at most three that hold the circle, until none is outside."""
    i = int(np.argmax((x - x[0]) ** 2 + (y - y[0]) ** 2))
    held = [(float(x[0]), float(y[0])), (float(x[i]), float(y[i]))] if i else [(float(x[0]), float(y[0]))]
    cx, cy, r = _through(held)
    for _ in range(100):
        d = (x - cx) ** 2 + (y - cy) ** 2
        i = int(np.argmax(d))
        if d[i] <= (r + 1e-7) ** 2:
            break
        new = (float(x[i]), float(y[i]))
        best = None
        for support in ([[q] for q in held] + [[held[a], held[b]] for a in range(len(held)) for b in range(a)]):
            c = _through([*support, new])
            if (best is None or c[2] < best[0][2]) and all((q[0] - c[0]) ** 2 + (q[1] - c[1]) ** 2 <= (c[2] + 1e-7) ** 2 for q in held):
                best = c, [*support, new]
        if best is None:
            break
        (cx, cy, r), held = best
    return cx, cy, r


def _hull(p: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, anticlockwise."""
    p = sorted(set(p))
    if len(p) < 3:
        return p
    out: list[list[tuple[float, float]]] = []
    for row in (p, p[::-1]):
        h: list[tuple[float, float]] = []
        for q in row:
            while len(h) >= 2 and (h[-1][0] - h[-2][0]) * (q[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (q[0] - h[-2][0]) <= 0:
                h.pop()
            h.append(q)
        out.append(h[:-1])
    return out[0] + out[1]


def records(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the points that lie outside the convex hull of all points before them, and the last point.

    The hull of any first k points is the hull of the records among them.
    """
    found, hull, at, n = [0], [(float(x[0]), float(y[0]))], 1, len(x)
    while at < n:
        wide = 64
        if len(hull) < 3:
            (ax, ay), (bx, by) = hull[0], hull[-1]
            px, py = x[at : at + wide], y[at : at + wide]
            between = ((px - ax) * (px - bx) <= 0) & ((py - ay) * (py - by) <= 0)
            out = ~between | ((bx - ax) * (py - ay) != (by - ay) * (px - ax))
            k = int(np.argmax(out)) if out.any() else -1
        else:
            hx, hy = np.array(hull).T
            ex, ey = np.roll(hx, -1) - hx, np.roll(hy, -1) - hy
            k = -1
            while at < n:
                px, py = x[at : at + wide, None], y[at : at + wide, None]
                out = (ex * (py - hy) - ey * (px - hx) < 0).any(axis=1)
                if out.any():
                    k = int(np.argmax(out))
                    break
                at += len(out)
                wide = min(4 * wide, 65_536)
        if k < 0:
            if len(hull) < 3:
                at += len(out)
                continue
            break
        at += k
        found.append(at)
        hull = _hull([*hull, (float(x[at]), float(y[at]))])
        at += 1
    if found[-1] != n - 1:
        found.append(n - 1)
    return np.array(found)


def longest_stays(t: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, shortest: int, ends_too: bool = False) -> list[tuple[int, int]]:
    """Stretches [i, j] of pings that fit a circle of ``radius``, as long as possible, disjoint, the longest first.

    t is integer time; ``shortest`` the least duration. With ``ends_too`` stretches at the first or last ping count whatever their duration.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(t) - 1)]
    while todo:
        lo, hi = todo.pop()
        if lo > hi or (t[hi] - t[lo] < shortest and not (ends_too and (lo == 0 or hi == len(t) - 1))):
            continue
        windows = _maximal(x, y, lo, hi, radius)
        good = [w for w in windows if t[w[1]] - t[w[0]] >= shortest]
        if not good and ends_too:
            good = [w for w in windows if w[0] == 0 or w[1] == len(t) - 1]
        if good:
            i, j = max(good, key=lambda w: (t[w[1]] - t[w[0]], -w[0]))
            out.append((i, j))
            todo += [(lo, i - 1), (j + 1, hi)]
    return sorted(out)


def _maximal(x, y, lo: int, hi: int, radius: float) -> list[tuple[int, int]]:
    """All stretches of lo..hi within a circle of ``radius`` that can be extended at neither end."""
    limit = radius + 1e-6
    mx, my = (x[lo : hi + 1].min() + x[lo : hi + 1].max()) / 2, (y[lo : hi + 1].min() + y[lo : hi + 1].max()) / 2
    if ((x[lo : hi + 1] - mx) ** 2 + (y[lo : hi + 1] - my) ** 2).max() <= limit * limit:
        return [(lo, hi)]
    out = []
    i, j, cx, cy = lo, lo, x[lo], y[lo]
    while j < hi:
        n = j + 1
        if (x[n] - cx) ** 2 + (y[n] - cy) ** 2 <= limit * limit:
            # all that the present circle takes at once
            ahead = (x[n : n + 256] - cx) ** 2 + (y[n : n + 256] - cy) ** 2 <= limit * limit
            ahead = ahead[: hi - j]
            j += int(len(ahead) if ahead.all() else np.argmin(ahead))
            continue
        px, py = x[i : n + 1], y[i : n + 1]
        if ((px - x[n]) ** 2 + (py - y[n]) ** 2).max() <= 4 * limit * limit:
            c = smallest_circle(px, py)
            if c[2] <= limit:
                cx, cy, j = c[0], c[1], n
                continue
        out.append((i, j))
        # the first ping from which the stretch with ping n fits: pings too far from n end it, then bisection
        far = np.flatnonzero((px - x[n]) ** 2 + (py - y[n]) ** 2 > 4 * limit * limit)
        a, b = i + (int(far[-1]) + 1 if len(far) else 1), n
        while a < b:
            m = (a + b) // 2
            if smallest_circle(x[m : n + 1], y[m : n + 1])[2] <= limit:
                b = m
            else:
                a = m + 1
        i, j = a, n
        cx, cy, _ = smallest_circle(x[i : n + 1], y[i : n + 1])
    out.append((i, j))
    return out
