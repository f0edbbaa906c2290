"""Problem 7: regions that hold a point and places near it."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.functions import geometry as g
from tamarind.functions.frames import frame
from tamarind.session import table

#: Regions, and signs of their geometries, that one pass broadcasts; a larger gazetteer is worked off in passes over blocks of it.
REGIONS_PER_PASS, SIGNS_PER_PASS = 20_000, 64_000_000


class RegionIndex:
    """Triangles and discs of a block of regions under one bounding-volume hierarchy."""

    def __init__(self, regions: list[tuple], near_m: float):
        self.codes = [r[0] for r in regions]
        self.polygons, boxes, kinds, owners, points = [], [], [], [], []
        for k, (_code, lat, lng, geojson) in enumerate(regions):
            polygons = g.polygons_of(geojson)
            for polygon in polygons:
                self.polygons.append(polygon)
                made = g.ear_clip(polygon)
                if made is None:  # rings that cross: its box is the candidate, the exact test decides
                    xs, ys = zip(*polygon[0])
                    boxes.append((min(xs), min(ys), max(xs), max(ys)))
                    kinds.append(2), owners.append((k, len(self.polygons) - 1)), points.append((0.0,) * 6)
                for t in made or []:
                    xs, ys = zip(*t)
                    boxes.append((min(xs), min(ys), max(xs), max(ys)))
                    kinds.append(0), owners.append((k, len(self.polygons) - 1)), points.append(tuple(v for p in t for v in p))
            if lat is not None and lng is not None and lat == lat and lng == lng and abs(lat) <= 90:
                dy = np.degrees(near_m / g.EARTH_RADIUS_M) * (1 + 1e-9) + 1e-9
                top = min(90.0, abs(lat) + dy)
                ratio = np.sin(near_m / g.EARTH_RADIUS_M / 2) / max(np.cos(np.radians(top)), 1e-12)
                dx = 360.0 if ratio >= 1 else np.degrees(2 * np.arcsin(ratio)) * (1 + 1e-9) + 1e-9
                for turn in (-360.0, 0.0, 360.0):  # longitudes on the other side of the date line
                    if -540 <= lng + turn + dx and lng + turn - dx <= 180 and lng + turn + dx >= -180:
                        boxes.append((lng + turn - dx, lat - dy, lng + turn + dx, lat + dy))
                        kinds.append(1), owners.append((k, -1)), points.append((lng, lat, 0.0, 0.0, 0.0, 0.0))
        self.near_m = near_m
        self.kinds = np.array(kinds, dtype=np.int8)
        self.owners = np.array(owners, dtype=np.int64).reshape(-1, 2)
        self.points = np.array(points, dtype=float).reshape(-1, 6)
        self.tree = g.BoundingVolumes(np.array(boxes, dtype=float).reshape(-1, 4))

    def find(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(point, region, inside)`` of every relation, each once."""
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for items, points in self.tree.candidates(x, y):
            px, py = x[points], y[points]
            for i in items:
                x0, y0, x1, y1 = self.tree.boxes[i]
                near = points[(px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)]
                if not len(near):
                    continue
                region, polygon = self.owners[i]
                if self.kinds[i] == 1:
                    lng, lat = self.points[i, :2]
                    hit = near[g.haversine_m(y[near], x[near], lat, lng) <= self.near_m]
                else:
                    hit = self._inside(i, polygon, near, x, y)
                if len(hit):
                    found.append((hit, np.full(len(hit), region), int(self.kinds[i] != 1)))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        rows = np.column_stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([np.full(len(f[0]), f[2]) for f in found])])
        rows = np.unique(rows, axis=0)  # a point on a shared edge lies in two triangles
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def _inside(self, i, polygon, near, x, y):
        """Points of a triangle; those within rounding of an edge, or of crossing rings, by the exact test."""
        if self.kinds[i] == 2:
            return near[[g.holds(self.polygons[polygon], x[p], y[p]) for p in near]]
        ax, ay, bx, by, cx, cy = self.points[i]
        px, py = x[near], y[near]
        turns = []
        for ox, oy, ex, ey in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)):
            l, r = (ex - ox) * (py - oy), (ey - oy) * (px - ox)
            turns.append(np.where(np.abs(l - r) <= 1e-12 * (np.abs(l) + np.abs(r)) + 1e-22, 0.0, l - r))
        least = np.minimum.reduce(turns)
        sure = near[least > 0]
        unsure = near[least == 0]
        if not len(unsure):
            return sure
        return np.concatenate([sure, unsure[[g.holds(self.polygons[polygon], x[p], y[p]) for p in unsure]]])


def regions_of_points(points: DataFrame, regions: DataFrame, *, key: str, lat: str, lng: str, near_m: float = 1000.0) -> DataFrame:
    """``(key, village_code, relation)``: INSIDE the region's area, NEAR its centroid.

    ``regions`` has code, centroid_lat, centroid_lng and geom_geojson.  Each pass broadcasts a block
    of at most ``REGIONS_PER_PASS`` regions as a hierarchy of triangles and discs and maps the points
    over it without a shuffle; there are as many passes as blocks.  A point on an edge, also of a
    hole, is INSIDE.  Points with a null or not finite coordinate have no relations; regions with
    neither geometry nor centroid have none; a code in several rows counts once; a repeated key
    gives its rows for each of its points.
    """
    spark = points.sparkSession
    rows = regions.where("code is not null").select("code", "centroid_lat", "centroid_lng", "geom_geojson").orderBy("code")

    def blocks():
        block, size = [], 0
        for r in rows.toLocalIterator():
            if block and (len(block) >= REGIONS_PER_PASS or size + len(r[3] or "") > SIGNS_PER_PASS):
                yield block
                block, size = [], 0
            block.append(tuple(r))
            size += len(r[3] or "")
        yield block

    kind = dict(points.dtypes)[key]
    placed = points.select(F.col(key), F.col(lat).cast("double").alias("_lat"), F.col(lng).cast("double").alias("_lng")).where("_lat is not null and _lng is not null and not isnan(_lat) and not isnan(_lng)")
    out, passes = None, 0
    for block in blocks():
        shared, mark, passes = spark.sparkContext.broadcast(block), uuid4().hex, passes + 1

        def relate(batches, shared=shared, mark=mark):
            for b in batches:
                index = _index(mark, shared, near_m)
                point, region, inside = index.find(b["_lng"].to_numpy(), b["_lat"].to_numpy())
                yield frame(**{key: b[key].to_numpy()[point]}, village_code=[index.codes[r] for r in region], relation=["INSIDE" if i else "NEAR" for i in inside])

        made = placed.mapInPandas(relate, f"`{key}` {kind}, village_code string, relation string")
        out = made if out is None else out.unionByName(made)
    return out.distinct() if passes > 1 else out


_INDEXES: dict[str, RegionIndex] = {}


def _index(mark: str, shared, near_m: float) -> RegionIndex:
    """The hierarchy of a block, built once in each worker."""
    if mark not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[mark] = RegionIndex(shared.value, near_m)
    return _INDEXES[mark]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions_of_points(table(spark, sf_dir, "resolved_locations"), table(spark, sf_dir, "villages"), key="resolved_location_id", lat="lat", lng="lng")
