"""Farthest-first orders of points: exact, with distances to few points each and no job per pick.

Repeatedly the candidate farthest from all points taken so far comes next; ties go to the larger score, then name.  Distances to
the points taken only shrink, so a stored distance is an upper bound.  The plane is cut into a fixed number of cells.
A step gathers the ``POOL`` best candidates of every cell in one task and takes from them while it is certain that no
other candidate comes before: those of a cell have at most the stored distance of the cell's next best, and at most the
distance from the cell's farthest corner to a point taken meanwhile.  Then each candidate's distance is brought up to
date, by the new points that can be nearer than the farthest candidate of its cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.plans.ordering import number_rows, top_rows
from netreach.plans.staging import stage

#: Cells on a side of the plane, and candidates of a cell that one step looks at.
SIDE, POOL = 32, 32


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of distinct points (n, 2)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def hull_points(points: DataFrame) -> DataFrame:
    """(x, y) of the corners: hulls of each partition first, then the hull of their corners."""
    def partial(batches):
        kept = np.zeros((0, 2))
        for batch in batches:
            kept = hull(np.concatenate([kept, batch[["x", "y"]].to_numpy(float)]))
        if len(kept):
            yield pd.DataFrame(kept, columns=["x", "y"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(hull(rows[["x", "y"]].to_numpy(float)), columns=["x", "y"])

    corners = points.select("x", "y").mapInPandas(partial, "x double, y double")
    return corners.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(whole, "x double, y double")


def first_pick(points: DataFrame) -> DataFrame:
    """The point with the largest mean distance to all others, one row (none if there are no points).

    A mean of distances is convex, so its largest value is at a corner of the hull, and only corners meet all points.
    """
    corners = stage(hull_points(points))
    every = points.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    listed = corners.groupBy().agg(F.collect_list(F.struct("x", "y")).alias("_c"))  # the corners alone
    met = every.crossJoin(F.broadcast(listed)).select(F.explode("_c").alias("c"), "_x", "_y")
    distance = F.sqrt(F.pow(F.col("c.x") - F.col("_x"), F.lit(2)) + F.pow(F.col("c.y") - F.col("_y"), F.lit(2)))
    mean = met.groupBy("c").agg((F.sum(distance) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("mean"))
    mean = mean.select("c.x", "c.y", F.round("mean", 6).alias("mean"))
    return stage(top_rows(points.join(F.broadcast(mean), ["x", "y"]), [F.desc("mean"), F.desc("score"), F.desc("wwtp")], 1).drop("mean"))


def _take(limit: int | None, box: tuple[float, float, float, float]):
    """The work of one step: rows of kind 0 (candidates), 1 (cells) and 2 (points taken before) to picks and points to compare."""
    x0, y0, wide, high = box

    def corners(cells: pd.DataFrame) -> np.ndarray:
        """(x low, x high, y low, y high) of each cell."""
        return np.stack([x0 + cells["cx"] * wide, x0 + (cells["cx"] + 1) * wide, y0 + cells["cy"] * high, y0 + (cells["cy"] + 1) * high], 1)

    def farthest(edges: np.ndarray, x: float, y: float) -> np.ndarray:
        return np.hypot(np.maximum(np.abs(edges[:, 0] - x), np.abs(edges[:, 1] - x)), np.maximum(np.abs(edges[:, 2] - y), np.abs(edges[:, 3] - y)))

    def nearest(edges: np.ndarray, x: float, y: float) -> np.ndarray:
        return np.hypot(np.maximum(0, np.maximum(edges[:, 0] - x, x - edges[:, 1])), np.maximum(0, np.maximum(edges[:, 2] - y, y - edges[:, 3])))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells, before = rows[rows["kind"] == 1], rows[rows["kind"] == 2]
        pool = rows[rows["kind"] == 0].sort_values(["score", "wwtp"], ascending=False, kind="stable")
        edges, bound, top = corners(cells), np.round(cells["bound"].to_numpy(float), 6), cells["d"].to_numpy(float)
        # the score and name of a cell's next best count while its distance is the one that was stored
        next_best = [(s, w) for s, w in zip(cells["score"], cells["wwtp"], strict=True)]
        new = list(zip(before["x"], before["y"], strict=True))
        picks = []
        if not new:
            at, d = pool[["x", "y"]].to_numpy(float), pool["d"].to_numpy(float).copy()
            names, scores, out = pool["wwtp"].tolist(), pool["score"].tolist(), np.zeros(len(pool), bool)
            while len(picks) < len(d) and (limit is None or len(picks) < limit):
                # the first of the largest is the one with the larger score and name
                k = int(np.argmax(np.round(d, 6)))
                key = (float(np.round(d[k], 6)), scores[k], names[k])
                if picks and any((float(bound[c]), *next_best[c]) > key for c in np.flatnonzero(bound >= key[0])):
                    break
                picks.append((names[k], *at[k], d[k]))
                d = np.minimum(d, np.hypot(at[:, 0] - at[k, 0], at[:, 1] - at[k, 1]))
                corner = np.round(farthest(edges, *at[k]), 6)
                for c in np.flatnonzero(corner < bound):
                    next_best[c] = (float("inf"), "")
                bound = np.minimum(bound, corner)
                out[k] = True
                d[out] = -np.inf
            new = [(x, y) for _, x, y, _ in picks]
        # points that may be nearer to a candidate of the cell than what it has now
        limit_of = np.minimum(top, np.min([farthest(edges, x, y) for x, y in new], axis=0)) if new else top
        near = []
        for x, y in new:
            for c in np.flatnonzero(nearest(edges, x, y) <= limit_of + 1e-9):
                near.append((cells["cx"].iloc[c], cells["cy"].iloc[c], x, y))
        told = pd.DataFrame([("pick", i, w, x, y, d, None, None) for i, (w, x, y, d) in enumerate(picks)]
                            + [("near", None, None, x, y, None, cx, cy) for cx, cy, x, y in near],
                            columns=["kind", "i", "wwtp", "x", "y", "d", "cx", "cy"])
        return told.astype({"i": "Int64", "cx": "Int64", "cy": "Int64", "d": float})

    return run


_STEP = "kind string, i long, wwtp string, x double, y double, d double, cx long, cy long"


def _step(state: DataFrame, before: DataFrame | None, limit: int | None, box: tuple) -> tuple[DataFrame, DataFrame]:
    """One step: (picks, candidates left with their new distances), both staged."""
    cell = ["cx", "cy"]
    ranked = state.withColumn("_r", F.row_number().over(
        Window.partitionBy(*cell).orderBy(F.round("d", 6).desc(), F.desc("score"), F.desc("wwtp")))).filter(F.col("_r") <= POOL + 1)
    ranked = stage(ranked)  # at most SIDE x SIDE x (POOL + 1) rows
    cells = ranked.groupBy(*cell).agg(F.max("d").alias("d"), F.coalesce(F.max(F.when(F.col("_r") > POOL, F.col("d"))), F.lit(-1.0)).alias("bound"),
                                      F.max(F.when(F.col("_r") > POOL, F.col("score"))).alias("score"), F.max(F.when(F.col("_r") > POOL, F.col("wwtp"))).alias("wwtp"))
    names = ["kind", "wwtp", "x", "y", "score", "d", "bound", *cell]

    def part(rows: DataFrame, kind: int) -> DataFrame:
        missing = {c: F.lit(None).cast("string" if c == "wwtp" else "double") for c in names if c not in rows.columns}
        return rows.withColumns({**missing, "kind": F.lit(kind)}).select(*[F.col(c) if c in ("kind", "wwtp") else F.col(c).cast("double").alias(c) for c in names])

    rows = part(ranked.filter(F.col("_r") <= POOL), 0).unionByName(part(cells, 1))
    if before is not None:
        rows = rows.unionByName(part(before.select("x", "y"), 2))
    done = stage(rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_take(limit, box), _STEP))
    picks = done.filter("kind = 'pick'").select("i", "wwtp", "x", "y")
    near = done.filter("kind = 'near'").groupBy(*cell).agg(F.collect_list(F.struct("x", "y")).alias("_near"))
    distance = F.array_min(F.transform("_near", lambda p: F.sqrt(F.pow(F.col("x") - p["x"], F.lit(2)) + F.pow(F.col("y") - p["y"], F.lit(2)))))
    left = state.join(F.broadcast(picks.select("wwtp")), "wwtp", "left_anti").join(F.broadcast(near), cell, "left")  # at most one pool
    return picks, stage(left.withColumn("d", F.least("d", distance)).drop("_near"))


def farthest_first(candidates: DataFrame, chosen: DataFrame | None, n: int | None) -> DataFrame:
    """(ord, wwtp, x, y): the first ``n`` (all if None) of ``candidates`` (wwtp, x, y, score) after the points ``chosen`` (x, y).

    With nothing chosen the first is the one with the largest mean distance to all others.  Candidates without
    coordinates come last, by score and name.  ``chosen`` is read in one task, at first; its rows are points of a plan
    such as one for each census area.
    """
    has = F.col("x").isNotNull() & F.col("y").isNotNull()
    located = stage(candidates.filter(has).select("wwtp", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "score"))
    low_x, low_y, high_x, high_y, count = located.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
    room = count if n is None else min(n, count)
    picked, at = None, 0
    if room > 0:
        # a little wider than the points, so that the last ones are inside
        wide, high = ((b - a) * 1.000001 / SIDE or 1.0 for a, b in ((low_x, high_x), (low_y, high_y)))
        box = (low_x, low_y, wide, high)

        def cell(c: Column, start: float, size: float) -> Column:
            return F.least(F.floor((c - start) / size), F.lit(SIDE - 1)).cast("long")

        state = located.withColumns({"d": F.lit(float("inf")), "cx": cell(F.col("x"), low_x, wide), "cy": cell(F.col("y"), low_y, high)})
        before = chosen.filter(has).select("x", "y") if chosen is not None else None
        if before is None or before.isEmpty():
            one = first_pick(located)
            picked, at = one.select(F.lit(1).cast("long").alias("ord"), "wwtp", "x", "y"), 1
            state, before = state.join(F.broadcast(one.select("wwtp")), "wwtp", "left_anti"), one
        _, state = _step(state, before, None, box)
        while at < room:
            picks, state = _step(state, None, room - at, box)
            found = picks.count()
            rows = picks.select((F.col("i") + at + 1).alias("ord"), "wwtp", "x", "y")
            picked, at = rows if picked is None else picked.unionByName(rows), at + found
    loose = candidates.filter(~has).select("wwtp", "score")
    if n is None or at < n:
        last = loose.orderBy(F.desc("score"), F.desc("wwtp")).limit(n - at) if n is not None else loose
        # names descend, which number_rows cannot say, so its positions run from the end
        back = number_rows(last.withColumn("_s", F.coalesce("score", F.lit(float("-inf")))), [], [F.col("_s"), F.col("wwtp")], "_i")
        total = last.agg(F.count(F.lit(1)).alias("_n"))
        tail = back.crossJoin(F.broadcast(total)).select(
            (F.col("_n") - F.col("_i") + 1 + at).alias("ord"), "wwtp", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
        picked = tail if picked is None else picked.unionByName(tail)
    return picked.select("ord", "wwtp", "x", "y")
