"""Greedy covers of many groups at once, exact and without a job per pick.

A greedy cover takes, again and again, the site with the largest new mass; ties go to the smaller ``tie``, then name.
New masses only fall while sites are taken, so a mass that was computed once is an upper bound.  A round hands the sites with
the largest masses of each group to one task, as many as fit, which takes from them as long as the next pick comes
before the best site left outside; that order is exact, and a round takes many picks.  Masses are then computed anew.
Groups that fit one task as a whole are finished there.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netreach.plans.ordering import number_rows
from netreach.plans.staging import stage

#: Open (site, item) pairs of a group, and sites of a large one, that one task works on.
TASK_PAIRS, HEAD = 1_000_000, 4_096


def lazy_greedy(sites: np.ndarray, items: np.ndarray, mass: np.ndarray, tie: dict, limit: int | None, stop: tuple | None = None) -> list[tuple[str, float]]:
    """Picks (site, new mass) over the open pairs of one group; a bound is recomputed only when it is the largest.

    ``stop`` is the key (minus mass, tie, name) of the first site that is not among them.
    """
    names, site = np.unique(sites, return_inverse=True)
    item = np.unique(items, return_inverse=True)[1]
    order = np.argsort(site, kind="stable")
    cuts = np.searchsorted(site[order], np.arange(len(names) + 1))
    own = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    taken = np.zeros(item.max(initial=-1) + 1, bool)

    def gain(k: int) -> float:
        return round(float(math.fsum(mass[own[k]][~taken[item[own[k]]]])), 6)

    heap = [(-gain(k), tie[name], name, k) for k, name in enumerate(names)]
    heapq.heapify(heap)
    picks: list[tuple[str, float]] = []
    while heap and (limit is None or len(picks) < limit):
        bound, t, name, k = heapq.heappop(heap)
        if stop is not None and (bound, t, name) > stop:
            break
        now = gain(k)
        if now <= 0:
            continue
        if -now > bound:
            heapq.heappush(heap, (-now, t, name, k))
            continue
        picks.append((name, now))
        taken[item[own[k]]] = True
    return picks


def _finish(open_: DataFrame, parts: list[str], limit: int | None, tasks: int) -> DataFrame:
    """Picks of groups that fit a task each; whole groups are dealt to about ``tasks`` pieces of work.

    ``open_``: (parts, wwtp, item, mass, tie) and ``stop``, the key that the picks of the group have to come before, or null.
    """
    def run(piece: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in piece.groupby(parts, sort=False):
            tie = dict(zip(group["wwtp"], group["tie"], strict=True))
            at = group["stop"].iloc[0]
            stop = None if at is None else (at["g"], at["t"], at["w"])
            picks = lazy_greedy(group["wwtp"].to_numpy(str), group["item"].to_numpy(str), group["mass"].to_numpy(float), tie, limit, stop)
            first = [group[p].iloc[0] for p in parts]
            out += [(*first, w, tie[w], gain) for w, gain in picks]
        return pd.DataFrame(out, columns=[*parts, "wwtp", "tie", "gain"])

    schema = open_.select(*parts, "wwtp", "tie", F.col("mass").alias("gain")).schema
    piece = F.pmod(F.xxhash64(*parts), F.lit(tasks))
    return open_.select(*parts, "wwtp", "item", "mass", "tie", "stop").withColumn("_piece", piece).groupBy("_piece").applyInPandas(run, schema)


def _round(open_: DataFrame, parts: list[str], limit: int | None, task_pairs: int) -> tuple[DataFrame, DataFrame]:
    """(sites taken, pairs still open), both staged."""
    site = [*parts, "wwtp"]
    gains = open_.groupBy(*site).agg(F.round(F.sum("mass"), 6).alias("gain"), F.first("tie").alias("tie"), F.count(F.lit(1)).alias("_pairs"))
    order = Window.partitionBy(*parts).orderBy(F.desc("gain"), "tie", "wwtp")
    # the head of each group and the site after it; map tasks forward no more of a group
    ranked = gains.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= HEAD + 1)
    ranked = ranked.withColumn("_sum", F.sum("_pairs").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct((-F.col("gain")).alias("g"), F.col("tie").alias("t"), F.col("wwtp").alias("w"))
    inside = (F.col("_sum") <= task_pairs) & (F.col("_r") <= HEAD)
    ranked = stage(ranked.withColumns({"_in": inside, "key": key}))
    stop = ranked.groupBy(*parts).agg(F.min(F.when(~F.col("_in"), F.col("key"))).alias("stop"))
    heads = open_.join(ranked.filter("_in").select(*site), site).join(stop, parts)
    taken = _finish(heads, parts, limit, open_.sparkSession.sparkContext.defaultParallelism)
    # a first site that does not fit a task is taken as it is
    alone = ranked.filter((F.col("_r") == 1) & ~F.col("_in")).select(*site, "tie", "gain")
    taken = stage(taken.unionByName(alone))
    items = open_.join(taken.select(*site), site, "left_semi").select(*parts, "item").distinct()
    return taken, stage(open_.join(items.hint("merge"), [*parts, "item"], "left_anti"))


def greedy_cover(
    pairs: DataFrame, ties: DataFrame, parts: list[str] | None = None, limit: int | None = None, task_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """(parts, wwtp, tie, gain, ord) of every site that adds mass, in greedy order; the first ``limit`` of a group if given.

    ``pairs``: (parts, wwtp, item, mass), of repeated pairs the largest mass; ``ties``: (parts, wwtp, tie), smaller first and
    null before all.  Groups must not be null.
    """
    given = parts or []
    parts = given or ["_group"]
    if not given:
        pairs, ties = pairs.withColumn("_group", F.lit(0)), ties.withColumn("_group", F.lit(0))
    tie = F.coalesce(F.col("tie").cast("double"), F.lit(float("-inf"))).alias("tie")
    once = pairs.groupBy(*parts, "wwtp", "item").agg(F.max("mass").cast("double").alias("mass"))
    # pairs often come from an explode, which the planner takes for small: no side of this join is broadcast
    open_ = stage(once.filter("mass > 0").join(ties.select(*parts, "wwtp", tie).hint("merge"), [*parts, "wwtp"]))
    order = [-F.col("gain"), F.col("tie"), F.col("wwtp")]
    picks, cores = None, open_.sparkSession.sparkContext.defaultParallelism
    none = F.lit(None).cast("struct<g: double, t: double, w: string>")
    while True:
        sizes = open_.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
        largest, total = (x or 0 for x in sizes.agg(F.max("_n"), F.sum("_n")).first())
        small = open_ if largest <= task_pairs else open_.join(sizes.filter(F.col("_n") <= task_pairs).drop("_n"), parts)
        done = _finish(small.withColumn("stop", none), parts, limit, max(cores, 2 * total // max(task_pairs, 1)))
        picks = done if picks is None else picks.unionByName(done)
        if largest <= task_pairs:
            break
        open_ = open_.join(sizes.filter(F.col("_n") > task_pairs).drop("_n"), parts)
        taken, open_ = _round(open_, parts, limit, task_pairs)
        picks = stage(picks.unionByName(taken))
        if limit is not None:  # later picks come after earlier ones, so a group with enough of them is done
            full = picks.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= limit).drop("_n")
            open_ = open_.join(full, parts, "left_anti")
    if limit is not None:
        return _first(picks, parts, order, limit).drop("_group")
    return number_rows(picks, given, order, "ord").drop("_group")


def _first(rows: DataFrame, parts: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered; map tasks forward no more than n of a group."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).filter(F.col("ord") <= n)
