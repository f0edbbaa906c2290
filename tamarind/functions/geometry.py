"""Plane geometry of lng/lat polygons: GeoJSON reading, ear clipping, exact containment, bounding volumes."""

from __future__ import annotations

import json
from fractions import Fraction

import numpy as np

EARTH_RADIUS_M = 6_371_000.0


def polygons_of(geojson: str | None) -> list[list[list[tuple[float, float]]]]:
    """Polygons (outer ring, then holes) of any GeoJSON object; nothing for null, broken or other text.

    Rings lose their closing point, repeated points and further coordinates; rings under three
    points are left out.
    """
    if not geojson:
        return []
    try:
        found, stack = [], [json.loads(geojson)]
    except ValueError:
        return []
    while stack:
        o = stack.pop()
        if not isinstance(o, dict):
            continue
        kind, at = o.get("type"), o.get("coordinates")
        if kind == "Feature":
            stack.append(o.get("geometry"))
        elif kind in ("FeatureCollection", "GeometryCollection"):
            stack.extend(o.get("features") or o.get("geometries") or [])
        elif kind in ("Polygon", "MultiPolygon") and isinstance(at, list):
            for rings in [at] if kind == "Polygon" else at:
                try:
                    clean = [_ring(r) for r in rings]
                except (TypeError, ValueError, IndexError):
                    continue
                if clean and len(clean[0]) >= 3:
                    found.append([clean[0], *(r for r in clean[1:] if len(r) >= 3)])
    return found


def _ring(points) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for p in points:
        xy = (float(p[0]), float(p[1]))
        if not out or out[-1] != xy:
            out.append(xy)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def _cross(o, a, b) -> float:
    """Sign of the turn o-a-b: float where the error bound allows, else exact."""
    l, r = (a[0] - o[0]) * (b[1] - o[1]), (a[1] - o[1]) * (b[0] - o[0])
    d = l - r
    if abs(d) > 4e-16 * (abs(l) + abs(r)) + 1e-300:
        return d
    ox, oy, ax, ay, bx, by = (Fraction(v) for v in (*o, *a, *b))
    exact = (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)
    return (exact > 0) - (exact < 0)


def _area2(ring) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))


def _in_triangle(p, a, b, c) -> bool:
    return _cross(a, b, p) >= 0 and _cross(b, c, p) >= 0 and _cross(c, a, p) >= 0


def _bridge(outer, hole):
    """Cut a hole open: join its rightmost point to a point of the outer ring that it sees."""
    k = max(range(len(hole)), key=lambda i: hole[i])
    m = hole[k]
    best, at = None, None
    n = len(outer)
    for i in range(n):
        a, b = outer[i], outer[(i + 1) % n]
        if (a[1] - m[1]) * (b[1] - m[1]) <= 0 and a[1] != b[1]:
            x = a[0] + (m[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
            if x >= m[0] and (best is None or x < best):
                best, at = x, i if a[0] > b[0] else (i + 1) % n
    if at is None:
        return None
    p, hit = outer[at], (best, m[1])
    inside = [i for i in range(n) if outer[i] != p and outer[i][0] >= m[0] and (_in_triangle(outer[i], m, hit, p) or _in_triangle(outer[i], m, p, hit))]
    if inside:
        at = min(inside, key=lambda i: (abs(outer[i][1] - m[1]) / max(outer[i][0] - m[0], 1e-12), outer[i][0]))
    return outer[: at + 1] + hole[k:] + hole[: k + 1] + outer[at:]


def ear_clip(rings) -> list[tuple] | None:
    """Triangles (counter-clockwise) that make up a polygon with holes; None where the rings allow none.

    Holes are first joined to the outer ring by bridges, rightmost hole first.
    """
    outer = rings[0] if _area2(rings[0]) > 0 else rings[0][::-1]
    for hole in sorted(rings[1:], key=lambda r: max(r), reverse=True):
        joined = _bridge(outer, hole if _area2(hole) < 0 else hole[::-1])
        if joined is None:
            return None
        outer = joined
    ring, out, begin = list(outer), [], 0
    while len(ring) > 3:
        for step in range(len(ring)):
            i = (begin + step) % len(ring)  # goes on beside the last ear
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            turn = _cross(a, b, c)
            if turn < 0 or turn == 0 and a != c and b not in (a, c):
                continue
            if turn > 0 and any(p not in (a, b, c) and _in_triangle(p, a, b, c) for p in ring):
                continue
            if turn > 0:
                out.append((a, b, c))
            ring.pop(i)
            begin = max(i - 1, 0)
            break
        else:
            # Only points on straight edges are left to cut; else the rings cross.
            flat = next((i for i in range(len(ring)) if _cross(ring[i - 1], ring[i], ring[(i + 1) % len(ring)]) == 0), None)
            if flat is None:
                return None
            ring.pop(flat)
    if len(ring) == 3 and _cross(*ring) > 0:
        out.append(tuple(ring))
    return out


def holds(polygon, x: float, y: float) -> bool:
    """Whether a polygon with holes holds a point, edges included, decided exactly."""
    p, inside = (x, y), False
    for ring in polygon:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) and _cross(a, b, p) == 0:
                return True
            if (a[1] > y) != (b[1] > y) and (_cross(a, b, p) > 0) == (b[1] > a[1]):
                inside = not inside
    return inside


def haversine_m(lat1, lng1, lat2, lng2):
    """Great-circle distance in metres of arrays of degrees."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1, h)))


class BoundingVolumes:
    """Bounding-volume hierarchy over boxes ``[n, 4]`` (x0, y0, x1, y1), split at medians of the longer side."""

    def __init__(self, boxes: np.ndarray, leaf: int = 8):
        self.boxes, self.nodes = boxes, []
        if len(boxes):
            self._build(np.arange(len(boxes)), leaf)

    def _build(self, items: np.ndarray, leaf: int) -> int:
        own = self.boxes[items]
        at = len(self.nodes)
        box = (*own[:, :2].min(0), *own[:, 2:].max(0))
        self.nodes.append(None)
        if len(items) <= leaf:
            self.nodes[at] = (box, items, None)
        else:
            mid = (own[:, :2] + own[:, 2:]) / 2
            order = items[np.argsort(mid[:, int(np.argmax(np.ptp(mid, axis=0)))], kind="stable")]
            half = len(order) // 2
            self.nodes[at] = (box, None, (self._build(order[:half], leaf), self._build(order[half:], leaf)))
        return at

    def candidates(self, x: np.ndarray, y: np.ndarray):
        """Yields ``(items, points)``: items of a leaf and the points inside its box."""
        stack = [(0, np.arange(len(x)))] if self.nodes else []
        while stack:
            at, points = stack.pop()
            (x0, y0, x1, y1), items, children = self.nodes[at]
            px, py = x[points], y[points]
            points = points[(px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)]
            if len(points):
                if items is None:
                    stack += [(c, points) for c in children]
                else:
                    yield items, points
