import json
import random

import pytest

from tamarind.functions import geometry as g
from tamarind.operators.spatial import regions_of_points

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]


def test_readers_take_every_form():
    polygon = {"type": "Polygon", "coordinates": [SQUARE, HOLE]}
    feature = {"type": "Feature", "geometry": polygon}
    for o in (polygon, feature, {"type": "FeatureCollection", "features": [feature]}, {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE]]}, {"type": "GeometryCollection", "geometries": [polygon]}):
        assert g.polygons_of(json.dumps(o)) == [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]]]
    for bad in (None, "", "{", "[]", '{"type":"Polygon","coordinates":[[[1]]]}', '{"type":"Point","coordinates":[1,2]}'):
        assert g.polygons_of(bad) == []


@pytest.mark.parametrize("seed", range(12))
def test_ear_clipping_keeps_the_area(seed):
    r = random.Random(seed)
    import math

    star = lambda n, a, b: [(math.cos(2 * math.pi * k / n) * d, math.sin(2 * math.pi * k / n) * d) for k in range(n) for d in [r.uniform(a, b)]]
    ring, hole = star(14, 2, 5), star(6, 0.3, 0.9)
    if r.random() < 0.5:
        ring.reverse()
    made = g.ear_clip([ring, hole])
    assert made is not None
    assert sum(g._area2(list(t)) for t in made) == pytest.approx(abs(g._area2(ring)) - abs(g._area2(hole)))
    for _ in range(200):
        p = (r.uniform(-5, 5), r.uniform(-5, 5))
        assert any(g._in_triangle(p, *t) for t in made) == g.holds([ring, hole], *p)


def test_relations(spark):
    regions = spark.createDataFrame(
        [("A", None, None, json.dumps({"type": "Polygon", "coordinates": [SQUARE, HOLE]}), "x"), ("B", 1.5, 1.5, None, "x"), ("C", None, None, None, "x"), ("D", 0.0, 179.999, None, "x"), (None, 1.5, 1.5, None, "x"),
         ("E", None, None, json.dumps({"type": "Polygon", "coordinates": [[[4, 0], [8, 0], [8, 4], [4, 4]]]}), "x")],
        "code string, centroid_lat double, centroid_lng double, geom_geojson string, relation string")
    points = spark.createDataFrame(
        [(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 1.0, 1.5), (4, 2.0, 4.0), (5, None, 1.0), (6, float("nan"), 1.0), (7, 0.0, -179.999), (8, 1.5, 1.509), (9, 90.0, 0.0), (1, 3.0, 5.0)],
        "id long, lat double, lng double")
    got = sorted(tuple(r) for r in regions_of_points(points, regions, key="id", lat="lat", lng="lng").collect())
    assert got == [(1, "A", "INSIDE"), (1, "E", "INSIDE"), (2, "B", "NEAR"), (3, "A", "INSIDE"), (4, "A", "INSIDE"), (4, "E", "INSIDE"), (7, "D", "NEAR")]
    assert regions_of_points(points.limit(0), regions, key="id", lat="lat", lng="lng").count() == 0
    assert regions_of_points(points, regions.limit(0), key="id", lat="lat", lng="lng").count() == 0


def test_passes_over_blocks_give_the_same(spark, sf_dir, monkeypatch):
    from tamarind.operators import spatial

    whole = {tuple(r) for r in spatial.p7_found(spark, sf_dir).collect()}
    monkeypatch.setattr(spatial, "REGIONS_PER_PASS", 500)
    assert {tuple(r) for r in spatial.p7_found(spark, sf_dir).collect()} == whole
