"""Geodesics on the WGS-84 ellipsoid as numpy kernels (Vincenty 1975; points of foot and intersection by repeated azimuthal projection)."""

from __future__ import annotations

import numpy as np

# WGS-84.
A = 6378137.0
F = 1 / 298.257223563
B = A * (1 - F)
MEAN = (2 * A + B) / 3
EPS = 1e-10


def inverse(lon1, lat1, lon2, lat2):
    """Distance (m), forward azimuth at 1 and arrival azimuth at 2 (degrees, [0, 360)). Nearly antipodal points are out of scope (NaN)."""
    lon1, lat1, lon2, lat2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (lon1, lat1, lon2, lat2)))
    L = np.radians((lon2 - lon1 + 180.0) % 360.0 - 180.0)
    u1, u2 = np.arctan((1 - F) * np.tan(np.radians(lat1))), np.arctan((1 - F) * np.tan(np.radians(lat2)))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = L.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, c1 * c2 * sl / sin_s, 0.0)
            cos2 = 1 - sin_a**2
            cos_m = np.where(cos2 > 1e-15, cos_s - 2 * s1 * s2 / cos2, 0.0)
            c = F / 16 * cos2 * (4 + F * (4 - 3 * cos2))
            new = L + (1 - c) * F * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            done = np.abs(new - lam) < 1e-13
            lam = new
            if done.all():
                break
        u = cos2 * (A * A - B * B) / (B * B)
        ka = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        kb = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = kb * sin_s * (cos_m + kb / 4 * (cos_s * (2 * cos_m**2 - 1) - kb / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
        dist = np.where(sin_s > 0, B * ka * (sigma - d), 0.0)
        sl, cl = np.sin(lam), np.cos(lam)
        a1 = np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl)) % 360.0
        a2 = np.degrees(np.arctan2(c1 * sl, -s1 * c2 + c1 * s2 * cl)) % 360.0
    bad = ~done
    return np.where(bad, np.nan, dist), np.where(bad, np.nan, a1), np.where(bad, np.nan, a2)


def direct(lon, lat, azimuth, distance):
    """Longitude, latitude and azimuth after ``distance`` metres (may be negative) along a geodesic."""
    lon, lat, azimuth, distance = np.broadcast_arrays(*(np.asarray(v, float) for v in (lon, lat, azimuth, distance)))
    a = np.radians(azimuth)
    sa, ca = np.sin(a), np.cos(a)
    tu = (1 - F) * np.tan(np.radians(lat))
    cu = 1 / np.sqrt(1 + tu * tu)
    su = tu * cu
    s1 = np.arctan2(tu, ca)
    sin_a = cu * sa
    cos2 = 1 - sin_a**2
    u = cos2 * (A * A - B * B) / (B * B)
    ka = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    kb = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    sigma = first = distance / (B * ka)
    for _ in range(200):
        m = np.cos(2 * s1 + sigma)
        ss, cs = np.sin(sigma), np.cos(sigma)
        new = first + kb * ss * (m + kb / 4 * (cs * (2 * m * m - 1) - kb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))
        if np.all(np.abs(new - sigma) < 1e-14):
            sigma = new
            break
        sigma = new
    ss, cs, m = np.sin(sigma), np.cos(sigma), np.cos(2 * s1 + sigma)
    t = su * ss - cu * cs * ca
    lat2 = np.arctan2(su * cs + cu * ss * ca, (1 - F) * np.hypot(sin_a, t))
    lam = np.arctan2(ss * sa, cu * cs - su * ss * ca)
    c = F / 16 * cos2 * (4 + F * (4 - 3 * cos2))
    L = lam - (1 - c) * F * sin_a * (sigma + c * ss * (m + c * cs * (2 * m * m - 1)))
    return (lon + np.degrees(L) + 180.0) % 360.0 - 180.0, np.degrees(lat2), np.degrees(np.arctan2(sin_a, -t)) % 360.0


def distance(lon1, lat1, lon2, lat2):
    return inverse(lon1, lat1, lon2, lat2)[0]


def intercept(ax, ay, bx, by, cx, cy):
    """Fraction of a-b (not clamped) at which the infinite geodesic through a and b comes nearest to c; 0 where a = b."""
    d, az, _ = inverse(ax, ay, bx, by)
    flat = ~(d > 0)
    s = np.zeros(np.broadcast(d, cx).shape)
    for _ in range(10):
        px, py, pa = direct(ax, ay, az, s)
        e, ea, _ = inverse(px, py, cx, cy)
        step = MEAN * np.arctan(np.tan(np.minimum(e, MEAN * 1.5) / MEAN) * np.cos(np.radians(ea - pa)))
        s = s + step
        if np.all((np.abs(step) < 1e-9) | flat):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(flat, 0.0, s / d)


def interpolate(ax, ay, bx, by, f):
    """Point at fraction f along a-b."""
    d, az, _ = inverse(ax, ay, bx, by)
    x, y, _ = direct(ax, ay, az, d * f)
    return x, y


def azimuth(ax, ay, bx, by, f):
    """Azimuth at fraction f along a-b, in [0, 360): forward at the start, arrival at the end, that of the point between."""
    d, a1, a2 = inverse(ax, ay, bx, by)
    mid = direct(ax, ay, a1, d * f)[2]
    f = np.asarray(f, float)
    return np.where(f < EPS, a1, np.where(f > 1 - EPS, a2, mid)) % 360.0


def envelope(lon, lat, radius):
    """West, south, east, north of the circle."""
    north, south = direct(lon, lat, 0.0, radius)[1], direct(lon, lat, 180.0, radius)[1]
    east, west = direct(lon, lat, 90.0, radius)[0], direct(lon, lat, 270.0, radius)[0]
    return west, south, east, north


def intersect(ax, ay, bx, by, cx, cy, dx, dy):
    """Where the infinite geodesics a-b and c-d cross, near the middle of the four points; NaN for parallel ones."""
    turn = lambda v: (v - ax + 180.0) % 360.0 - 180.0 + ax
    px, py = (ax + turn(bx) + turn(cx) + turn(dx)) / 4, (ay + by + cy + dy) / 4
    for _ in range(20):
        line = []
        for x, y in ((ax, ay), (bx, by), (cx, cy), (dx, dy)):
            d, a, _ = inverse(px, py, x, y)
            r = MEAN * np.tan(np.minimum(d, MEAN * 1.5) / MEAN)
            line.append((r * np.sin(np.radians(a)), r * np.cos(np.radians(a))))
        (x1, y1), (x2, y2), (x3, y3), (x4, y4) = line
        with np.errstate(divide="ignore", invalid="ignore"):
            k = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / ((x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3))
        x, y = x1 + k * (x2 - x1), y1 + k * (y2 - y1)
        r = np.hypot(x, y)
        px, py, _ = direct(px, py, np.degrees(np.arctan2(x, y)), MEAN * np.arctan(r / MEAN))
        if np.all((r < 1e-7) | np.isnan(r)):
            break
    return px, py


class Line:
    """A polyline: vertices, segment lengths and total length."""

    __slots__ = ("x", "y", "seg", "cum", "length")

    def __init__(self, x, y):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        self.seg = distance(self.x[:-1], self.y[:-1], self.x[1:], self.y[1:]) if len(self.x) > 1 else np.zeros(0)
        self.cum = np.concatenate([[0.0], np.cumsum(self.seg)])
        self.length = float(self.cum[-1])

    def intercept(self, px: float, py: float) -> tuple[float, float]:
        """(fraction of the length, distance) of the closest point; the first of equals; 0 for a line without length."""
        if not self.length:
            return 0.0, float(distance(self.x[0], self.y[0], px, py)) if len(self.x) else float("nan")
        f = np.clip(intercept(self.x[:-1], self.y[:-1], self.x[1:], self.y[1:], px, py), 0.0, 1.0)
        qx, qy = interpolate(self.x[:-1], self.y[:-1], self.x[1:], self.y[1:], f)
        d = distance(qx, qy, px, py)
        i = int(np.argmin(d))
        return float((self.cum[i] + f[i] * self.seg[i]) / self.length), float(d[i])

    def _at(self, f: float) -> tuple[int, float]:
        s = f * self.length
        i = min(int(np.searchsorted(self.cum, s, side="right")) - 1, len(self.seg) - 1)
        return i, (s - self.cum[i]) / self.seg[i] if self.seg[i] else 0.0

    def interpolate(self, f: float) -> tuple[float, float]:
        if f <= EPS or not self.length:
            return float(self.x[0]), float(self.y[0])
        if f >= 1 - EPS:
            return float(self.x[-1]), float(self.y[-1])
        i, g = self._at(f)
        x, y = interpolate(self.x[i], self.y[i], self.x[i + 1], self.y[i + 1], g)
        return float(x), float(y)

    def azimuth(self, f: float) -> float:
        i, g = (0, 0.0) if f <= EPS or not self.length else (len(self.seg) - 1, 1.0) if f >= 1 - EPS else self._at(f)
        return float(azimuth(self.x[i], self.y[i], self.x[i + 1], self.y[i + 1], g))


#: Ends of a segment up to so many metres from a point are measured in the point's own plane.
PLANE_M = 3000.0
_E2 = F * (2 - F)


def _small(t):
    """Sine and cosine of small angles (under 0.003)."""
    q = t * t
    return t * (1 - q / 6), 1 - q / 2 * (1 - q / 12)


def _chart(s0, c0, dl, dp):
    """Normal coordinates (metres east and north along geodesics) of near points, dl and dp radians off an origin at a latitude of sine s0 and cosine c0, by
    Gauss's middle latitude."""
    sh, ch = _small(dp / 2)
    s = s0 * ch + c0 * sh
    w = 1 - _E2 * s * s
    n = A / np.sqrt(w)
    x, y = n * (c0 * ch - s0 * sh) * dl, n * (1 - _E2) / w * dp
    st, ct = _small(dl * s / 2)
    return x * ct - y * st, x * st + y * ct


def _unchart(s0, c0, x, y):
    """Radians east and north of the origin of normal coordinates."""
    w = 1 - _E2 * s0 * s0
    n = A / np.sqrt(w)
    east, north = 1 / (n * c0), w / (n * (1 - _E2))
    dl, dp = x * east, y * north
    for _ in range(12):
        u, v = _chart(s0, c0, dl, dp)
        u, v = x - u, y - v
        dl += u * east
        dp += v * north
        if not len(u) or max(np.abs(u).max(), np.abs(v).max()) < 1e-6:  # what is left is a thousandth of this
            break
    return dl, dp


def feet_of(ax, ay, bx, by, cx, cy):
    """Nearest point of the segment a-b to c: fraction in [0, 1] and distance; and a function that gives its longitude and latitude and the azimuth of a-b there,
    for the pairs at given positions.

    Short segments near c are measured in the plane of c's normal coordinates, in which geodesics that pass near c are straight (better than
    a millimetre for ends within 3 km); all others, and those near the poles, on the ellipsoid.
    """
    turn = lambda v: (v + 180.0) % 360.0 - 180.0
    cr = np.radians(cy)
    s0, c0 = np.sin(cr), np.cos(cr)
    al, bl, ap, bp = turn(ax - cx), turn(bx - cx), ay - cy, by - cy
    with np.errstate(invalid="ignore"):
        # 0.03 degrees are over 3 km
        near = (np.maximum(np.abs(ap), np.abs(bp)) < 0.03) & (np.maximum(np.abs(al), np.abs(bl)) * c0 < 0.03) & (np.abs(cy) < 80)
    rad = np.pi / 180
    k = np.flatnonzero(near)
    px, py = _chart(s0[k], c0[k], al[k] * rad, ap[k] * rad)
    qx, qy = _chart(s0[k], c0[k], bl[k] * rad, bp[k] * rad)
    flat = np.maximum(px * px + py * py, qx * qx + qy * qy) < PLANE_M**2
    if not flat.all():
        near[k[~flat]] = False
        k, px, py, qx, qy = k[flat], px[flat], py[flat], qx[flat], qy[flat]
    f, d = np.empty(len(cy)), np.empty(len(cy))
    fx, fy, ux, uy = (np.zeros(len(cy)) for _ in range(4))
    ex, ey = qx - px, qy - py
    q = ex * ex + ey * ey
    with np.errstate(divide="ignore", invalid="ignore"):
        f[k] = np.where(q > 0, np.clip(-(px * ex + py * ey) / q, 0, 1), 0.0)
    ux[k], uy[k] = ex, ey
    # at the end exactly the end, so that segments that share it are equally near
    last = f[k] == 1
    fx[k], fy[k] = np.where(last, qx, px + f[k] * ex), np.where(last, qy, py + f[k] * ey)
    d[k] = np.sqrt(fx[k] ** 2 + fy[k] ** 2)
    k = np.flatnonzero(~near)
    lon, lat, azi = (np.zeros(len(cy)) if len(k) else np.zeros(0) for _ in range(3))
    if len(k):
        a = [v[k] for v in (ax, ay, bx, by)]
        f[k] = np.clip(intercept(*a, cx[k], cy[k]), 0, 1)
        lon[k], lat[k] = interpolate(*a, f[k])
        d[k] = distance(lon[k], lat[k], cx[k], cy[k])
        azi[k] = azimuth(*a, f[k])

    def at(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dl, dp = _unchart(s0[pos], c0[pos], fx[pos], fy[pos])
        sh, ch = _small(dp / 2)
        x, y = turn(cx[pos] + dl / rad), cy[pos] + dp / rad
        t = ((np.arctan2(ux[pos], uy[pos]) + dl * (s0[pos] * ch + c0[pos] * sh)) / rad) % 360.0
        k = np.flatnonzero(~near[pos])
        if len(k):
            x[k], y[k], t[k] = lon[pos[k]], lat[pos[k]], azi[pos[k]]
        return x, y, t

    return f, d, at


def feet(ax, ay, bx, by, cx, cy):
    """Nearest point of the segment a-b to c: fraction in [0, 1], longitude, latitude, distance, azimuth of a-b there (see ``feet_of``)."""
    f, d, at = feet_of(*np.broadcast_arrays(*(np.asarray(v, float) for v in (ax, ay, bx, by, cx, cy))))
    x, y, turn = at(np.arange(len(f)))
    return f, x, y, d, turn
