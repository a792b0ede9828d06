"""Estimates, the oracle and the greedy order against scalar versions, one problem at a time."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfell.operators import evaluate, mesh, region, selection

EDGES = "src string, dst string, rtt double"


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def cost(p, circles):
    return sum((d - r) ** 2 if (d := km(p, (la, lo))) > r else 0.001 * d for la, lo, r in circles)


def clip(p):
    return tuple(min(max(x, -b), b) for x, b in zip(p, (90.0, 180.0)))


def simplex_search(start, circles, tol=1.0, iterations=200):
    """Nelder and Mead's rules for two variables within bounds, told step by step."""
    f = lambda p: cost(p, circles)
    start = clip(start)
    corners = [start]
    for axis in (0, 1):
        p = list(start)
        p[axis] = 1.05 * p[axis] if p[axis] else 0.00025
        bound = (90.0, 180.0)[axis]
        if p[axis] > bound:
            p[axis] = 2 * bound - p[axis]
        corners.append(clip(p))
    points = sorted(((f(p), k, p) for k, p in enumerate(corners)), key=lambda x: x[0])
    points = [(v, p) for v, _, p in points]
    for _ in range(iterations - 1):
        best, worst = points[0], points[-1]
        if max(abs(a - b) for _, p in points[1:] for a, b in zip(p, best[1])) <= tol and max(abs(v - best[0]) for v, _ in points[1:]) <= tol:
            break
        mid = tuple(sum(p[k] for _, p in points[:-1]) / 2 for k in (0, 1))
        at = lambda t: clip(tuple(m + t * (w - m) for m, w in zip(mid, worst[1])))  # noqa: B023, E731
        reflected = (f(at(-1)), at(-1))
        new = None
        if reflected[0] < best[0]:
            expanded = (f(at(-2)), at(-2))
            new = expanded if expanded[0] < reflected[0] else reflected
        elif reflected[0] < points[1][0]:
            new = reflected
        elif reflected[0] < worst[0]:
            outside = (f(at(-0.5)), at(-0.5))
            new = outside if outside[0] <= reflected[0] else None
        else:
            inside = (f(at(0.5)), at(0.5))
            new = inside if inside[0] < worst[0] else None
        if new:
            points[-1] = new
        else:
            points[1:] = [(f(p), p) for p in (clip(tuple(b + 0.5 * (x - b) for b, x in zip(best[1], p))) for _, p in points[1:])]
        points.sort(key=lambda x: x[0])
    return points[0][1]


class Target:
    """One target's region, as a sequence of measurements leaves it."""

    def __init__(self, guess=(0.0, 0.0), circles=()):
        self.guess, self.circles = guess, list(circles)

    def after(self, place, rtt):
        circles = [*self.circles, (*place, rtt * 100)]
        return Target(place if not self.circles else simplex_search(self.guess, circles), circles)

    def size(self):
        return max(0.0, min(r - km(self.guess, (la, lo)) for la, lo, r in self.circles)) if self.circles else 20037.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.floats(-85, 85), st.floats(-175, 175), st.floats(1, 90)), min_size=2, max_size=7), st.tuples(st.floats(-90, 90), st.floats(-180, 180)))
def test_minimiser_is_the_scalar_one(circles, start):
    circles = [(round(a, 3), round(b, 3), round(r, 2) * 100) for a, b, r in circles]
    start = tuple(round(x, 3) for x in start)
    lat, lon, radius = (np.array([x]) for x in zip(*circles))
    found = region.minimise(np.array([start]), lat, lon, radius)[0]
    want = simplex_search(start, circles)
    assert cost(tuple(found), circles) == pytest.approx(cost(want, circles), rel=1e-6, abs=1e-6) and tuple(found) == pytest.approx(want, abs=1e-6)


def world(spark, n=6, seed=2):
    rng = random.Random(seed)
    at = {f"n{k}": (rng.uniform(-50, 50), rng.uniform(-150, 150)) for k in range(n)}
    pairs = {(a, b): 4.0 + km(at[a], at[b]) / 100 * rng.uniform(1, 1.6) for a in at for b in at if rng.random() < 0.85}
    locations = spark.createDataFrame([(a, *p) for a, p in at.items()], "addr string, lat double, lon double")
    return at, pairs, locations, spark.createDataFrame([(*k, v) for k, v in pairs.items()], EDGES)


def test_centroid_estimates(spark):
    at, pairs, locations, df = world(spark)
    got = {r["dst"]: (r["lat"], r["lon"]) for r in evaluate.estimate(df, locations, ["dst"]).collect()}
    for dst in at:
        circles = [(*at[s], pairs[s, d] * 100) for s, d in sorted(pairs) if d == dst]
        seed = tuple(sum(c[k] for c in circles) / len(circles) for k in (0, 1))
        want = simplex_search(seed, circles) if len(circles) > 1 else circles[0][:2]
        assert got[dst] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("seed", [2, 3])
def test_oracle_at_every_rank(spark, seed):
    at, pairs, locations, df = world(spark, seed=seed)
    ranked = {}
    for dst in at:
        left, target, order = sorted((rtt, s) for (s, d), rtt in pairs.items() if d == dst), Target(), []
        while left:
            tries = [(km(target.after(at[s], rtt).guess, at[dst]), k) for k, (rtt, s) in enumerate(left)]
            rtt, s = left.pop(min(tries)[1])
            target = target.after(at[s], rtt)
            order.append(s)
        ranked[dst] = order
    want = [(order[k], dst) for k in range(6) for dst, order in sorted(ranked.items()) if k < len(order)]
    assert [(r["src"], r["dst"]) for r in selection.oracle_picks(df, locations, 10_000).orderBy("seq").collect()] == want


@pytest.mark.parametrize("seed", [2, 3])
def test_intended_greedy_at_every_step(spark, seed):
    at, pairs, locations, df = world(spark, seed=seed)
    targets = {d: Target() for d in sorted(at)}
    left = {d: sorted(s for s, x in pairs if x == d) for d in targets}
    want, model = [], lambda t, s: km(at[s], t.guess) * 1.5 / 100
    while any(left.values()):
        best = None
        for d, t in targets.items():
            for s in left[d]:
                gain = t.size() - t.after(at[s], model(t, s)).size() if t.circles else 1e6
                if best is None or gain > best[0] + 1e-9:
                    best = gain, s, d
        gain, s, d = best
        before = targets[d].size()
        targets[d] = targets[d].after(at[s], pairs[s, d])
        left[d].remove(s)
        want.append((s, d, gain, before - targets[d].size(), model(targets[d], s)))
    got = selection.greedy_picks_intended(df, locations, 10_000).orderBy("seq").collect()
    assert [(r["src"], r["dst"]) for r in got] == [w[:2] for w in want]
    for r, (_, _, gain, actual, predicted) in zip(got, want):
        assert (r["utility"], r["actual_util"], r["predicted_rtt"]) == pytest.approx((gain, actual, predicted), abs=1e-4)


@pytest.mark.parametrize("limit", [9, 20, 10_000])
def test_deepened_greedy_is_the_deep_one(spark, limit):
    _, _, locations, df = world(spark, n=7, seed=5)
    deep, shallow = (selection.greedy_picks_intended(df, locations, limit, depth=d).orderBy("seq").collect() for d in (50, 1))
    assert [tuple(r[c] for c in ("seq", "k", "src", "dst", "rtt")) for r in shallow] == [tuple(r[c] for c in ("seq", "k", "src", "dst", "rtt")) for r in deep]
    for a, b in zip(shallow, deep):
        assert (a["utility"], a["actual_util"], a["predicted_rtt"]) == pytest.approx((b["utility"], b["actual_util"], b["predicted_rtt"]))


def test_centroid_curve(spark):
    at, pairs, locations, df = world(spark)
    rows = evaluate.compare(df, locations, ("random", "smart_perfect"), (3, 9, 99)).collect()
    assert len(rows) == 6
    for r in rows:
        picks = [(p["src"], p["dst"]) for p in selection.strategy(r["strategy"])(df, locations, r["budget"]).collect()]
        errors, found = [], 0
        for dst in {d for _, d in pairs}:
            circles = [(*at[s], pairs[s, d] * 100) for s, d in sorted(picks) if d == dst]
            found += bool(circles)
            seed = tuple(sum(c[k] for c in circles) / len(circles) for k in (0, 1)) if circles else None
            errors.append(10_000.0 if not circles else km(circles[0][:2] if len(circles) == 1 else simplex_search(seed, circles), at[dst]))
        assert (r["targets_found"], r["n_targets"]) == (found, len(errors)) and r["avg_error_km"] == pytest.approx(sum(errors) / len(errors), abs=1e-3)


def test_nearest_curve(spark):
    at, pairs, locations, df = world(spark)
    names = (*selection.COMPARED, "intended_greedy")
    rows = evaluate.compare(df, locations, names, (4, 11, 99), evaluate.MODES[0]).collect()
    assert {r["strategy"] for r in rows} == set(names) and len(rows) == 12
    for r in rows:
        best = {}
        for p in selection.strategy(r["strategy"])(df, locations, r["budget"]).collect():
            best[p["dst"]] = min(best.get(p["dst"], (math.inf, "")), (p["rtt"], p["src"]))
        errors = [km(at[best[d][1]], at[d]) if d in best else 10_000.0 for d in {d for _, d in pairs}]
        assert r["targets_found"] == len(best) and r["avg_error_km"] == pytest.approx(sum(errors) / len(errors), abs=1e-6)


@pytest.mark.parametrize("ratio, decay, least", [(0.8, 0.9, 500), (0.8, 0.9, 9), (0.95, 0.7, 5), (0.8, 0.9, 1)])
def test_adaptive_mesh(spark, ratio, decay, least):
    rng = random.Random(4)
    names = [f"m{k}" for k in range(14)]
    pairs = {(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if rng.random() < 0.95 - 0.05 * min(i, j)}

    def survivors(share):
        pool = {x for p in pairs for x in p}
        while len(pool) > 1:
            own = [(a, b) for a, b in pairs if a in pool and b in pool and a != b]
            bound = share * (len(pool) - 1)
            left = {x for x in pool if sum(a == x for a, _ in own) >= bound and sum(b == x for _, b in own) >= bound}
            if left == pool:
                break
            pool = left
        return pool

    share, tries, best = ratio, 0, (set(), ratio)
    while True:
        pool = survivors(share)
        if len(pool) > len(best[0]) or tries == 0:
            best = pool, share
        if len(pool) >= least or len({x for p in pairs for x in p}) < least or share * decay < mesh.MIN_RATIO:
            break
        share, tries = share * decay, tries + 1
    found = mesh.adaptive(spark.createDataFrame([(*p, 1.0) for p in sorted(pairs)], EDGES), ratio, decay, least)
    assert {r["addr"] for r in found.nodes.collect()} == (pool if len(pool) >= least else best[0]) and found.relaxations == tries
    assert found.enough == (len(pool) >= least) and found.ratio == pytest.approx(share if found.enough else best[1])
