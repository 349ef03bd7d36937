"""Nearest sites and counts within radii, by branch and bound in a hierarchy of cells.

Sites of one area are sorted into cells of a quarter-degree tree (every step halves latitude and longitude four times) until a cell has
at most ``LEAF`` sites. Cells carry their numbers and the box of their sites. A site first looks in its own leaf; then it goes down the
tree with a lower and an upper bound of the distance to each box: a cell that lies wholly inside a radius is added from its count, one
that is too far is left, and only leaves that may hold a nearer site, or that a radius cuts, are visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.blocking import with_blocks
from ledgerlens.session import materialize

EARTH_KM = 6371.0
LEVELS = (0, 4, 8, 12, 16, 20, 24)
LEAF = 512
#: The tree is sent to the tasks, so it has at most about this many leaves; leaves of larger tables are larger.
MOST = 16_000
#: About how many sites' leaves a task has in Python at a time; and how many sites go down the tree together.
HELD, TOGETHER = 1 << 16, 512
FAR = float(np.pi * EARTH_KM)


def distance_km(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    a = np.sin(np.radians(lat_b - lat_a) / 2) ** 2 + np.cos(np.radians(lat_a)) * np.cos(np.radians(lat_b)) * np.sin(np.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(np.maximum(a, 0.0))))


def box_bounds(lat: np.ndarray, lon: np.ndarray, box: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """No point of the box (least and greatest latitude, least and greatest longitude) is nearer or farther than this."""
    south, north, west, east = box
    up = np.maximum(np.maximum(south - lat, lat - north), 0.0)
    turns = [np.maximum(np.maximum(west - x, x - east), 0.0) for x in (lon, lon - 360, lon + 360)]
    aside = np.minimum(np.minimum(*turns[:2]), turns[2])
    # to the meridian at the near side; beyond a quarter turn the way leads across that of a quarter turn
    meridian = EARTH_KM * np.arcsin(np.clip(np.cos(np.radians(lat)) * np.sin(np.radians(np.minimum(aside, 90.0))), 0.0, 1.0))
    low = np.maximum(EARTH_KM * np.radians(up), meridian)
    circle = lambda x: np.abs((lon - x + 180) % 360 - 180)
    wide = np.maximum(circle(west), circle(east))
    opposite = ((west <= lon + 180) & (lon + 180 <= east)) | ((west <= lon - 180) & (lon - 180 <= east))
    corner = np.maximum(distance_km(lat, 0.0, south, wide), distance_km(lat, 0.0, north, wide))
    high = np.where(opposite | (wide > 90), FAR, corner)
    return low * (1 - 1e-12) - 1e-9, high * (1 + 1e-12) + 1e-9


@dataclass
class Tree:
    """Cells of the areas with more than one leaf, parents before children; ``first`` and ``size`` are a cell's children."""

    areas: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray]]  # per level: sorted keys, and the cells' numbers
    inner: np.ndarray
    points: np.ndarray
    box: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def leaves(self, area: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """The leaf of each site; one of its own, below 0, for each area that isn't in the tree."""
        out = -1 - area
        if not len(self.areas):
            return out
        place = np.minimum(np.searchsorted(self.areas, area), len(self.areas) - 1)
        todo = np.flatnonzero(self.areas[place] == area)
        for level, (keys, cells) in zip(LEVELS, self.keys):
            if not len(todo):
                break
            at = np.searchsorted(keys, _key(level, place[todo], lat[todo], lon[todo]))
            out[todo] = cells[at]
            todo = todo[self.inner[cells[at]]]
        return out


def _spot(level: int, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << level
    part = lambda x, whole: np.clip(np.floor(x / whole * n), 0, n - 1).astype(np.int64)
    return part(lat + 90, 180), part(lon + 180, 360)


def _key(level: int, area: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    row, column = _spot(level, lat, lon)
    return ((area.astype(np.int64) << level | row) << level) | column


def build_tree(sites: DataFrame) -> Tree:
    """The tree over ``area, lat, lon, n``; only cells below one with more than a leaf's sites are collected."""
    leaf = max(LEAF, -(-sites.count() // MOST))
    cells = []
    for level in LEVELS:
        n = float(1 << level)
        part = lambda x, whole: F.least(F.greatest(F.floor(x / whole * n), F.lit(0)), F.lit((1 << level) - 1))  # noqa: B023, E731
        cells.append(F.struct(F.lit(level).alias("level"), part(F.col("lat") + 90, 180.0).alias("row"), part(F.col("lon") + 180, 360.0).alias("column")))
    rows = sites.select("area", "lat", "lon", "n", F.explode(F.array(*cells)).alias("cell")).select("area", "lat", "lon", "n", "cell.*")
    found = rows.groupBy("area", "level", "row", "column").agg(
        F.count("*").alias("sites"), F.sum("n").alias("points"), *[f(c).alias(f"{c}_{name}") for c in ("lat", "lon") for name, f in (("low", F.min), ("high", F.max))]
    )
    found = materialize(found, "cells")
    step = LEVELS[1]
    inner = found.where((F.col("sites") > leaf) & (F.col("level") < LEVELS[-1]))
    # each has more than a leaf's sites, so there are at most len(LEVELS) * MOST
    parents = F.broadcast(inner.select("area", (F.col("level") + step).alias("level"), F.col("row").alias("up"), F.col("column").alias("left")))
    above = {"up": F.shiftright("row", step), "left": F.shiftright("column", step)}
    below = found.withColumns(above).join(parents, ["area", "level", "up", "left"]).select(found.columns)
    kept = below.unionByName(inner.where("level = 0")).toPandas().sort_values(["level", "area", "row", "column"], ignore_index=True)
    areas = np.unique(kept["area"].to_numpy(np.int64))
    area = np.searchsorted(areas, kept["area"].to_numpy(np.int64))
    row, column, level = (kept[c].to_numpy(np.int64) for c in ("row", "column", "level"))
    inside = (kept["sites"].to_numpy() > leaf) & (level < LEVELS[-1])
    # numbers level by level, children in the order of their parents, so that each parent's are together
    keys, new, up, made = [], np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64), 0
    for depth in LEVELS:
        own = np.flatnonzero(level == depth)
        parent = np.full(len(own), -1)
        if depth and len(own):
            above, cells = keys[-1]
            parent = cells[np.searchsorted(above, ((area[own] << depth - step | row[own] >> step) << depth - step) | column[own] >> step)]
        by = np.argsort(parent, kind="stable")
        new[own[by]] = made + np.arange(len(own))
        up[made : made + len(own)] = parent[by]
        made += len(own)
        key = ((area[own] << depth | row[own]) << depth) | column[own]
        by = np.argsort(key)
        keys.append((key[by], new[own[by]]))
    order = np.argsort(new)
    roots = int((up < 0).sum())
    size = np.bincount(up[roots:], minlength=len(kept))
    first = roots + np.cumsum(size) - size
    box = np.stack([kept[c].to_numpy(float)[order] for c in ("lat_low", "lat_high", "lon_low", "lon_high")]) if len(kept) else np.zeros((4, 0))
    return Tree(areas, keys, inside[order], kept["points"].to_numpy(np.int64)[order], box, first, size)


def _in_leaves(radii: Sequence[float]):
    """Each site's nearest other in its own leaf, and the points of the leaf within each radius, itself included."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            for i in range(x.num_rows):
                held = x.column("held")[i].values
                site, lat, lon, n = (held.field(c).to_numpy(zero_copy_only=False) for c in ("site", "lat", "lon", "n"))
                low = held.field("low")
                order = np.array(pc.sort_indices(low))  # of equal distances the first, that is the smallest id
                site, lat, lon, n, low = site[order], lat[order], lon[order], n[order], low.take(pa.array(order))
                for at in range(0, len(site), 512):
                    km = distance_km(lat[at : at + 512, None], lon[at : at + 512, None], lat[None], lon[None])
                    rows = np.arange(len(km))
                    within = [(km <= r) @ n for r in radii]
                    km[rows, at + rows] = np.inf
                    best = km.argmin(axis=1)
                    near = km[rows, best]
                    cut = slice(at, at + 512)
                    counts = pa.array(np.stack(within, axis=1).tolist() if radii else [[]] * len(km), pa.list_(pa.int64()))
                    columns = [pa.array(site[cut]), pa.array(lat[cut]), pa.array(lon[cut]), pa.array(near), pc.if_else(pa.array(np.isfinite(near)), low.take(pa.array(best)), None), counts]
                    area = pa.array(np.full(len(km), x.column("area")[i].as_py()))
                    leaf = pa.array(np.full(len(km), x.column("leaf")[i].as_py()))
                    yield pa.RecordBatch.from_arrays([area, leaf, *columns], names=["area", "leaf", "site", "lat", "lon", "km", "low", "counts"])

    return of


def descend(tree: Tree, area: np.ndarray, leaf: np.ndarray, lat: np.ndarray, lon: np.ndarray, km: np.ndarray, radii: Sequence[float]):
    """What each site still has to ask: its number in the batch, the leaf, the bits of the radii to count there, and the distance to beat;
    and the points already counted from whole cells."""
    reach = km.copy()
    counted = np.zeros((len(lat), len(radii)), np.int64)
    root = np.searchsorted(tree.areas, area)
    who = np.flatnonzero(leaf >= 0)
    cell, bits = tree.keys[0][1][root[who]], np.full(len(who), (1 << len(radii)) - 1)
    asked = []
    while len(who):
        own = _within(tree.box[:, cell], lat[who], lon[who])
        low, high = box_bounds(lat[who], lon[who], tree.box[:, cell])
        np.minimum.at(reach, who[~own], high[~own])
        for k, r in enumerate(radii):
            open_ = (bits >> k & 1).astype(bool)
            whole = open_ & (high <= r) & ~own
            np.add.at(counted[:, k], who[whole], tree.points[cell[whole]])
            bits = np.where(whole | open_ & (low > r), bits & ~(1 << k), bits)
        go = own | (low <= reach[who]) | (bits > 0)
        who, cell, bits, low = who[go], cell[go], bits[go], low[go]
        ends = ~tree.inner[cell]
        away = ends & (cell != leaf[who])
        asked.append((who[away], cell[away], bits[away], low[away]))
        who, cell, bits = who[~ends], cell[~ends], bits[~ends]
        n = tree.size[cell]
        who, bits = np.repeat(who, n), np.repeat(bits, n)
        cell = np.repeat(tree.first[cell] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    who, cell, bits, low = (np.concatenate(v) for v in zip(*asked)) if asked else (np.zeros(0, np.int64),) * 4
    keep = (low <= reach[who]) | (bits > 0)
    return who[keep], cell[keep], bits[keep], np.minimum(reach[who[keep]], km[who[keep]]), counted


def _within(box: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """The site lies in the box, so it may be one of its sites."""
    return (box[0] <= lat) & (lat <= box[1]) & (box[2] <= lon) & (lon <= box[3])


def _asked(tree: Tree, radii: Sequence[float]):
    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, TOGETHER):
                x = whole.slice(at, TOGETHER)
                get = lambda c: x.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                site, lat, lon = get("site"), get("lat"), get("lon")
                who, cell, bits, reach, counted = descend(tree, get("area"), get("leaf"), lat, lon, get("km"), radii)
                some = np.flatnonzero(counted.any(axis=1)) if len(radii) else np.zeros(0, np.int64)
                rows = np.concatenate([who, some])
                none = lambda v: pa.array(v, mask=np.arange(len(rows)) >= len(who))  # noqa: B023, E731
                pad = lambda v: none(np.concatenate([v, np.zeros(len(some), v.dtype)]))  # noqa: B023, E731
                counts = [None] * len(who) + counted[some].tolist()
                columns = [pa.array(site[rows]), pa.array(lat[rows]), pa.array(lon[rows]), pad(cell), pad(bits), pad(reach), pa.array(counts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["site", "lat", "lon", "leaf", "bits", "reach", "counts"])

    return of


def _answered(radii: Sequence[float]):
    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            for i in range(x.num_rows):
                asked, held = x.column("asked")[i].values, x.column("held")[i].values
                get = lambda v, c: v.field(c).to_numpy(zero_copy_only=False)
                lat, lon, n, low = get(held, "lat"), get(held, "lon"), get(held, "n"), held.field("low")
                order = np.array(pc.sort_indices(low))
                lat, lon, n, low = lat[order], lon[order], n[order], low.take(pa.array(order))
                site, bits, reach = get(asked, "site"), get(asked, "bits"), get(asked, "reach")
                for at in range(0, len(site), 512):
                    cut = slice(at, at + 512)
                    km = distance_km(get(asked, "lat")[cut, None], get(asked, "lon")[cut, None], lat[None], lon[None])
                    best = km.argmin(axis=1)
                    near = km[np.arange(len(km)), best]
                    beats = near <= reach[cut] + 1e-9
                    within = np.stack([((km <= r) @ n) * (bits[cut] >> k & 1) for k, r in enumerate(radii)], axis=1).tolist() if radii else [[]] * len(km)
                    near = pa.array(np.where(beats, near, np.inf))
                    columns = [pa.array(site[cut]), near, pc.if_else(pa.array(beats), low.take(pa.array(best)), None), pa.array(within, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["site", "km", "low", "counts"])

    return of


def _by_group(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[pa.Table], pa.Table]:
    """``of`` for the rows of one group, so that Python holds a group and not a batch of 10,000 rows of lists."""
    return lambda table: pa.Table.from_batches(of(iter(table.combine_chunks().to_batches())))


def nearest_sites(sites: DataFrame, radii: Sequence[float] = ()) -> DataFrame:
    """``site, km, low, counts`` for ``sites`` (``site, area, lat, lon, n, low``; different places within an area).

    ``km`` and ``low`` are the distance and the id of the nearest other site of the area, the smaller id of equal ones; null for the only
    site of an area. ``counts`` has, for each radius, the sum of ``n`` over the area's sites within it, the site's own included.
    """
    tree = build_tree(sites)
    shared = sites.sparkSession.sparkContext.broadcast(tree)  # bounded by MOST
    kept = ["site", "lat", "lon", "n", "low"]

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            leaf = shared.value.leaves(*(x.column(c).to_numpy(zero_copy_only=False) for c in ("area", "lat", "lon")))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *x.columns], names=["leaf", *x.schema.names])

    leafed = sites.select("area", *kept).mapInArrow(placed, "leaf long, area long, site long, lat double, lon double, n long, low string")
    leaves = materialize(leafed.groupBy("leaf", "area").agg(F.collect_list(F.struct(*kept)).alias("held")), "leaves")
    parts = F.pmod(F.xxhash64("leaf", "area"), F.lit(-(-sites.count() // HELD) or 1)).alias("part")
    own = leaves.groupBy(parts).applyInArrow(_by_group(_in_leaves(radii)), "area long, leaf long, site long, lat double, lon double, km double, low string, counts array<long>")
    own = materialize(own, "own")
    found = own.select("site", "km", "low", "counts")
    if len(tree.areas):
        made = own.where("leaf >= 0").select("area", "leaf", "site", "lat", "lon", "km")
        asked = made.mapInArrow(_asked_of(shared, radii), "site long, lat double, lon double, leaf long, bits long, reach double, counts array<long>")
        asked = materialize(asked, "asked")
        lists = with_blocks(asked.where("leaf is not null").drop("counts"), ["leaf"], F.col("site")).groupBy("leaf", "__block")
        lists = lists.agg(F.collect_list(F.struct("site", "lat", "lon", "bits", "reach")).alias("asked"))
        # the join has placed the rows by leaf, so grouping them shuffles nothing
        met = lists.join(leaves.where("leaf >= 0").select("leaf", "held").hint("merge"), "leaf").groupBy("leaf", "__block")
        found = found.unionByName(met.applyInArrow(_by_group(_answered(radii)), "site long, km double, low string, counts array<long>"))
        whole = asked.where("counts is not null").select("site", F.lit(float("inf")).alias("km"), F.lit(None).cast("string").alias("low"), "counts")
        found = found.unionByName(whole)
    sums = [F.sum(F.get("counts", F.lit(k))).alias(f"__{k}") for k in range(len(radii))]
    best = F.min(F.when(F.col("low").isNotNull(), F.struct("km", "low"))).alias("__best")
    merged = found.groupBy("site").agg(best, *sums)
    counts = F.array(*[F.col(f"__{k}") for k in range(len(radii))]) if radii else F.array().cast("array<long>")
    return merged.select("site", F.col("__best.km").alias("km"), F.col("__best.low").alias("low"), counts.alias("counts"))


def _asked_of(shared, radii: Sequence[float]):
    return lambda parts: _asked(shared.value, radii)(parts)
