"""Areas on the sphere: centres, containment with holes and islands, across the date line and round a pole, nearest parents."""

import numpy as np
import pytest

from ledgerloom.operators import geo

RNG = np.random.default_rng(5)


def star(lon, lat, size, n, rng=RNG):
    """A ring of unevenly placed points around a place, not convex."""
    at = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = size * rng.uniform(0.4, 1, n)
    return [[float((lon + a * np.cos(t) + 180) % 360 - 180), float(lat + a * np.sin(t))] for a, t in zip(r, at, strict=True)]


def xyz(lon, lat):
    return geo._xyz(np.stack((np.asarray(lon, float), np.asarray(lat, float)), axis=-1))


def winds(lon, lat, ring):
    """Turns of the ring's directions, as seen from the point: an independent test of containment for small rings."""
    p = xyz(lon, lat)
    east = np.array([-np.sin(np.radians(lon)), np.cos(np.radians(lon)), 0])
    north = np.cross(p, east)
    a = xyz(*np.array(geo._ring(ring)).T)
    angle = np.arctan2(a @ north, a @ east)
    turn = (np.roll(angle, -1) - angle + np.pi) % (2 * np.pi) - np.pi
    return abs(turn.sum()) > np.pi


@pytest.mark.parametrize("lon, lat", [(25, 42), (179.5, 10), (-70, -60), (0, 0)])
def test_containment(lon, lat):
    outer, hole = star(lon, lat, 5, 23), star(lon, lat, 1.5, 9)
    ps = [((lon + x + 180) % 360 - 180, lat + y) for x, y in RNG.uniform(-6, 6, (400, 2))]
    got = geo.in_polygon(np.array([p[0] for p in ps]), np.array([p[1] for p in ps]), [outer, hole + hole[:1]])
    want = [winds(*p, outer) != winds(*p, hole) for p in ps]
    assert got.tolist() == want and 0 < sum(want) < 400
    cells = set(geo._cells([outer, hole]))
    assert all((int((x + 180) % 360 // geo.CELL), int(y // geo.CELL)) in cells for (x, y), w in zip(ps, want, strict=True) if w)


def test_round_a_pole():
    north = [[float(x), 70.0] for x in range(-180, 180, 30)]
    at = np.array([0.0, 45.0, 179.0]), np.array([89.0, 80.0, 60.0])
    assert geo.in_polygon(*at, [north]).tolist() == [True, True, False]
    south = [[float(x), -70.0] for x in range(-180, 180, 30)]
    assert geo.in_polygon(at[0], -at[1], [south]).tolist() == [True, True, False]
    assert {(int(x // geo.CELL), int(89 // geo.CELL)) for x in (0, 100, 359)} <= set(geo._cells([north]))


def test_centres_against_a_sum_over_the_area():
    """The centre of an area with a hole equals the mean of many points drawn evenly inside it."""
    for lon, lat in ((20, 50), (-179.9, -20)):
        polygon, island = [star(lon, lat, 8, 17), star(lon, lat, 2, 7)[::-1]], [star(lon, lat + 15, 3, 11)]
        y = np.degrees(np.arcsin(RNG.uniform(np.sin(np.radians(lat - 10)), np.sin(np.radians(lat + 20)), 300_000)))
        x = (lon + RNG.uniform(-10, 10, 300_000) + 180) % 360 - 180
        inside = geo.in_polygon(x, y, polygon) | geo.in_polygon(x, y, island)
        mean = xyz(x[inside], y[inside]).mean(axis=0)
        got = geo.spherical_centroid([polygon, island])
        assert np.degrees(np.arccos(np.clip(got @ mean / np.linalg.norm(mean), -1, 1))) < 0.1
    box = [[0.0, y / 100] for y in range(100)] + [[0.0, 1.0], [1.0, 1.0], [1.0, 0.0]]  # a thousand points on one side don't move it
    assert abs(np.degrees(np.arctan2(*geo.spherical_centroid([[box]])[1::-1])) - 0.5) < 1e-6
    assert np.allclose(geo.spherical_centroid([[[[10.0, 0.0], [20.0, 0.0]]]]), xyz(15, 0)) and np.isnan(geo.spherical_centroid([[]])).all()


def test_parents_by_brute_force(spark):
    rng = np.random.default_rng(8)
    parents = [(f"p{i:02d}", [[star(x, y, 4, 15, rng)] + ([star(x, y, 1, 6, rng)] if i % 2 else []) for x, y in rng.uniform((-180, -55), (180, 55), (2, 2))]) for i in range(14)]
    children = [(i, [[star(x, y, 0.5, 8, rng)]]) for i, (x, y) in enumerate([p[0] for _, g in parents for poly in g for p in [poly[0]] for _ in range(4)] + rng.uniform((-180, -60), (180, 60), (60, 2)).tolist())]
    children += [(1000, []), (1001, None), (1002, [[[[1.0, 1.0]]]])]
    got = {r["child_id"]: r["parent_id"] for r in geo.assign_parents(spark.createDataFrame(children, f"child_id int, geometry {geo.GEOMETRY}"), spark.createDataFrame(parents, f"parent_id string, geometry {geo.GEOMETRY}")).collect()}
    centres, held = {k: geo.spherical_centroid(g) for k, g in parents}, 0
    for k, g in children:
        c = geo.spherical_centroid(g)
        if np.isnan(c).any():
            assert k not in got
            continue
        lon, lat = float(np.degrees(np.arctan2(c[1], c[0]))), float(np.degrees(np.arcsin(c[2])))
        near = lambda ring: float(c @ xyz(*ring[0])) > 0.5
        inside = [n for n, g2 in parents if any(near(poly[0]) and winds(lon, lat, poly[0]) and not any(winds(lon, lat, h) for h in poly[1:]) for poly in g2)]
        held += bool(inside)
        assert got[k] == (min(inside) if inside else max(sorted(centres), key=lambda n: round(float(c @ centres[n]), 12)))
    assert held > 10
