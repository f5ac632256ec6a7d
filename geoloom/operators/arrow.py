"""Geometry that needs a loop per line or ring: Arrow-batched functions, many features at a time, batches in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import ship_package


def kept_points(points: np.ndarray, starts: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of many lines stay, all lines at once: `points` (rows) one line after another, `starts` where each begins.

    Every round looks at all stretches that are still open, of all lines together: the point furthest off its stretch's
    chord, the first of equals, stays if it is over `tolerance` off, and parts the stretch in two.
    """
    stops = np.append(starts[1:], len(points)) - 1
    kept = np.zeros(len(points), bool)
    kept[starts], kept[stops] = True, True
    a, b = starts, stops
    while True:
        wide = b - a > 1
        a, b = a[wide], b[wide]
        if not len(a):
            return kept
        inner = b - a - 1
        of = np.repeat(np.arange(len(a)), inner)
        begins = np.concatenate(([0], np.cumsum(inner)[:-1]))
        at = np.repeat(a + 1 - begins, inner) + np.arange(len(of))
        chord, away = (points[b] - points[a])[of], points[at] - points[a][of]
        length = (chord * chord).sum(axis=1)
        share = np.clip((chord * away).sum(axis=1) / np.where(length == 0, 1, length), 0, 1)
        off = np.sqrt(((away - share[:, None] * chord) ** 2).sum(axis=1))
        most = np.maximum.reduceat(off, begins)
        hit = np.flatnonzero(off == most[of])
        middle = at[hit[np.unique(of[hit], return_index=True)[1]]]
        parted = most > tolerance
        a, b, middle = a[parted], b[parted], middle[parted]
        kept[middle] = True
        a, b = np.concatenate((a, middle)), np.concatenate((middle, b))


def simplify(lines: DataFrame, key: str, points: str, tolerance: float, z_weight: float = 1.0) -> DataFrame:
    """The points of each line (an array of coordinate arrays) that keep it within `tolerance`; the last coordinate of three counts z_weight times."""

    @F.pandas_udf("array<int>")
    def kept(s: pd.Series) -> pd.Series:
        sizes = np.array([len(line) for line in s], np.int64)
        flat = np.zeros((sizes.sum(), 3))
        for k, point in enumerate(p for line in s for p in line):
            flat[k, : len(point)] = point
        flat[:, 2] *= z_weight
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        stay = kept_points(flat, starts[sizes > 0], tolerance)
        return pd.Series([np.flatnonzero(stay[a : a + n]).astype("int32") for a, n in zip(starts, sizes, strict=True)])

    return lines.select(key, kept(F.col(points)).alias("kept"))


def clip_ring(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Sutherland-Hodgman: the ring (array of [x, y]) inside the box, an empty array if nothing is."""

    @F.pandas_udf("array<array<double>>")
    def clipped(s: pd.Series) -> pd.Series:
        def side(p, inside, cross):
            out = []
            for a, b in zip(p[-1:] + p[:-1], p, strict=True):
                if inside(b):
                    out += [] if inside(a) else [cross(a, b)]
                    out.append(b)
                elif inside(a):
                    out.append(cross(a, b))
            return out

        def at_x(v):
            return lambda a, b: [v, a[1] + (b[1] - a[1]) * (v - a[0]) / (b[0] - a[0])]

        def at_y(v):
            return lambda a, b: [a[0] + (b[0] - a[0]) * (v - a[1]) / (b[1] - a[1]), v]

        def one(ring):
            p = [[float(v) for v in x] for x in ring]
            for inside, cross in ((lambda q: q[0] >= x0, at_x(x0)), (lambda q: q[0] <= x1, at_x(x1)), (lambda q: q[1] >= y0, at_y(y0)), (lambda q: q[1] <= y1, at_y(y1))):
                p = side(p, inside, cross) if p else p
            return p

        return s.map(one)

    return clipped(ring)


def _begins(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Rows at which a new group begins, where the rows of each stand together; nulls are equal."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for key in keys:
        own, gone = pdf[key].to_numpy(), pdf[key].isna().to_numpy()
        new[1:] |= np.where(gone[1:] | gone[:-1], gone[1:] != gone[:-1], own[1:] != own[:-1])
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows in order of `keys`, cut between groups, each with the rows at which groups begin: many whole groups at a time."""
    kept: list[pd.DataFrame] = []  # the group that may go on in the next batch
    for pdf in batches:
        if not len(pdf):
            continue
        joint = pd.concat([kept[-1][-1:], pdf[:1]]) if kept else pdf[:0]
        if len(_begins(joint, keys)) == 2:  # the group has ended with its batch
            whole = pd.concat(kept, ignore_index=True)
            kept = []
            yield whole, _begins(whole, keys)
        last = int(_begins(pdf, keys)[-1])
        if last:
            whole = pd.concat([*kept, pdf[:last]], ignore_index=True)
            kept = []
            yield whole, _begins(whole, keys)
        kept.append(pdf[last:])
    if kept:
        whole = pd.concat(kept, ignore_index=True)
        yield whole, _begins(whole, keys)


def _chains(first: list, last: list) -> Iterator[tuple[int, int, int, bool, bool]]:
    """`(ring, seq, fragment, reversed, closed)` of one group's fragments, numbered in order of way_id."""
    at_point: dict = {}  # fragments by either end, the last way first
    for k in range(len(first) - 1, -1, -1):
        at_point.setdefault(first[k], []).append(k)
        if last[k] != first[k]:
            at_point.setdefault(last[k], []).append(k)
    used = [False] * len(first)
    ring = 0
    for k in range(len(first)):
        if used[k]:
            continue
        used[k] = True
        chain, start, end = [(k, False)], first[k], last[k]
        while start != end:
            waiting = at_point[end]
            while waiting and used[waiting[-1]]:
                waiting.pop()
            if not waiting:
                break
            way = waiting.pop()
            used[way] = True
            chain.append((way, first[way] != end))
            end = last[way] if first[way] == end else first[way]
        for seq, (way, back) in enumerate(chain):
            yield ring, seq, way, back, start == end
        ring += 1


def assemble_rings(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments (keys, way_id, first, last as E7 pairs) joined end to end: `(keys, ring, seq, way_id, reversed, closed)`.

    One relation's fragments of one role are one group. A task reads its groups in order, many of them in each batch.
    """
    ship_package(fragments.sparkSession)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, begins in whole_groups(batches, keys):
            first, last = pdf["first"].tolist(), pdf["last"].tolist()
            spans = zip(begins.tolist(), [*begins[1:].tolist(), len(pdf)], strict=True)
            rows = [(ring, seq, a + at, back, closed) for a, b in spans for ring, seq, at, back, closed in _chains(first[a:b], last[a:b])]
            ring, seq, at, back, closed = (np.array(c) for c in zip(*rows, strict=True))
            out = pdf.iloc[at][[*keys, "way_id"]].reset_index(drop=True)
            out.insert(len(keys), "ring", ring)
            out.insert(len(keys) + 1, "seq", seq)
            yield out.assign(reversed=back, closed=closed)

    kinds = {f.name: f.dataType.simpleString() for f in fragments.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ring int, seq int, way_id long, reversed boolean, closed boolean"
    return fragments.select(*keys, "way_id", "first", "last").repartition(*keys).sortWithinPartitions(*keys, "way_id").mapInPandas(joined, schema)


def relaxed(body: np.ndarray, x: np.ndarray, z: np.ndarray, held: np.ndarray, rounds: int) -> np.ndarray:
    """The level of every cell of many bodies at once: `body` numbers them from 0 and does not fall, `held` is NaN where free."""
    starts = np.flatnonzero(np.append(True, body[1:] != body[:-1]))
    high = np.maximum.reduceat(z, starts) - np.minimum.reduceat(z, starts) + 3
    wide = np.maximum.reduceat(x, starts) - np.minimum.reduceat(x, starts) + 3
    base = np.concatenate(([0], np.cumsum(high * wide)[:-1]))  # every body has its own box of places, with a free rim
    high = high[body]
    place = base[body] + (x - np.minimum.reduceat(x, starts)[body] + 1) * high + z - np.minimum.reduceat(z, starts)[body] + 1
    order = np.argsort(place, kind="stable")
    ranked = place[order]
    beside = np.empty((4, len(place)), np.int64)  # the neighbours' rows, one past the end where there is none
    for k, step in enumerate((high, -high, 1, -1)):
        at = np.minimum(np.searchsorted(ranked, place + step), len(place) - 1)
        beside[k] = np.where(ranked[at] == place + step, order[at], len(place))
    n = (beside < len(place)).sum(axis=0)
    fixed = np.add.reduceat((~np.isnan(held)).astype(np.int64), starts)
    mean = np.add.reduceat(np.where(np.isnan(held), 0.0, held), starts) / np.maximum(fixed, 1)
    free = np.flatnonzero(np.isnan(held) & (n > 0) & (fixed[body] > 0))
    value = np.append(np.where(np.isnan(held), mean[body], held), 0.0)
    beside, n = beside[:, free], n[free]
    for _ in range(rounds):
        value[free] = value[beside].sum(axis=0) / n
    return value[:-1]


def relax_surface(cells: DataFrame, key: str, rounds: int = 200) -> DataFrame:
    """A smooth surface through the fixed cells of each body: free cells take the mean of their neighbours in the body.

    `cells` are (key, x, z, fixed) with fixed null where free; a body without a fixed cell is level with 0. A task reads
    its bodies in order and relaxes all that a batch holds at once.
    """
    ship_package(cells.sparkSession)

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, begins in whole_groups(batches, [key]):
            body = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(pdf))))
            level = relaxed(body, pdf.x.to_numpy(dtype=np.int64), pdf.z.to_numpy(dtype=np.int64), pdf.fixed.to_numpy(dtype=float), rounds)
            yield pdf.assign(level=level)[[key, "x", "z", "level"]]

    kind = dict(cells.dtypes)
    placed = cells.select(key, "x", "z", "fixed").repartition(key).sortWithinPartitions(key)
    return placed.mapInPandas(levels, f"{key} {kind[key]}, x {kind['x']}, z {kind['z']}, level double")
