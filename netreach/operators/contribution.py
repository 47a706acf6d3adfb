"""Transmission risk between nodes, its checks against mobility, and contribution rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.functions.expr import clip, pearson, ratio
from netreach.plans.ordering import exact_quantiles, number_rows, top_rows
from netreach.plans.sparse import product, row_normalize
from netreach.plans.staging import stage


def perturbation(
    edges: DataFrame, base: DataFrame, hop_coef: float, own_coef: float = 0.0, alpha: float = 0.3, skip_self: bool = True,
    renorm: bool = False,
) -> DataFrame:
    """Timewise risk (t, src, dst, risk): change in dst's forecast when src's input shrinks.

    For a linear model on diffused inputs the change is alpha x |coef x A[dst, src] x x[src]|, so
    one join over the edges replaces a re-scoring per node.  ``edges``: (t, src, dst, w) with
    row src reading from dst; ``base``: (t, node, x, pred).
    """
    a = row_normalize(edges.select("t", "src", "dst", "w"), ["t"])
    reads = a.select("t", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.lit(hop_coef) * F.col("w")).alias("c"))
    if own_coef:
        reads = reads.unionByName(base.select("t", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(own_coef).alias("c")))
    if skip_self:
        reads = reads.filter(F.col("src") != F.col("dst"))
    reads = reads.groupBy("t", "src", "dst").agg(F.sum("c").alias("c"))
    dev = base.groupBy("node").agg((F.stddev_pop("pred") + F.lit(1e-6)).alias("_dev"))
    src = base.select("t", F.col("node").alias("src"), "x")
    dst = base.join(dev, "node").select("t", F.col("node").alias("dst"), "pred", "_dev")
    r = reads.join(src, ["t", "src"]).join(dst, ["t", "dst"]).select(
        "t", "src", "dst",
        (F.abs(F.lit(alpha) * F.col("c") * F.col("x")) / F.col("_dev") / (F.abs("pred") + F.lit(1e-6))).alias("risk"))
    if renorm:
        rows = r.groupBy("t", "src").agg((F.sum("risk") + F.lit(1e-9)).alias("_row"))
        r = r.join(rows, ["t", "src"]).withColumn("risk", F.col("risk") / F.col("_row")).drop("_row")
    r = stage(r)
    top = r.agg(F.max("risk").alias("_top"))
    return r.crossJoin(F.broadcast(top)).withColumn(
        "risk", F.when(F.col("_top") > 0, F.col("risk") / F.col("_top")).otherwise(F.col("risk"))).drop("_top")


def model_perturbation(
    edges: DataFrame, scaled: DataFrame, pred: DataFrame, coefficients: dict[str, float], alpha: float = 0.3, self_dampen: float | None = None,
) -> DataFrame:
    """Timewise risk (t, src, dst, risk) of a linear forecast: change in dst's forecast when all of src's inputs shrink.

    The chain rule takes the place of a re-scoring for each node: src reaches dst over one edge with ``hop1``, over two with
    ``hop2``, and itself with its lags as well.  ``edges``: (t, src, dst, w), row src reading from dst; ``scaled``:
    (t, node, z); ``pred``: (t, node, prev, pred_scaled, lags), where ``prev`` is the step whose edges and values
    are read.  The diagonal stays, times ``self_dampen`` after scaling, or is left out if that is None.
    """
    a = row_normalize(edges.select("t", "src", "dst", "w"), ["t"])
    one = a.select("t", "src", "dst", (F.lit(coefficients.get("hop1", 0.0)) * F.col("w")).alias("c"))
    two = product(a, a, ["t"]).select("t", "src", "dst", (F.lit(coefficients.get("hop2", 0.0)) * F.col("w")).alias("c"))
    reach = one.unionByName(two).groupBy("t", "src", "dst").agg(F.sum("c").alias("c"))
    z = scaled.select("t", F.col("node").alias("dst"), "z")
    read = reach.join(z, ["t", "dst"]).select(F.col("t").alias("prev"), F.col("src").alias("node"), F.col("dst").alias("src"), (F.col("c") * F.col("z")).alias("v"))
    dev = pred.groupBy("node").agg((F.stddev_pop("pred_scaled") + F.lit(1e-6)).alias("_dev"))
    lags = [c for c in coefficients if c.startswith("lag")]
    own = F.lit(0.0)
    for c in lags:
        own = own + F.lit(coefficients[c]) * F.col(c)
    base = stage(pred.join(dev, "node").select("t", "node", "prev", "pred_scaled", "_dev", own.alias("own")))
    hops = base.select("t", "node", "prev").join(read, ["prev", "node"]).select("t", "src", "node", "v")
    both = hops.unionByName(base.select("t", F.col("node").alias("src"), "node", F.col("own").alias("v")))
    if self_dampen is None:
        both = both.filter(F.col("src") != F.col("node"))
    change = both.groupBy("t", "src", "node").agg(F.sum("v").alias("v"))
    r = stage(change.join(base, ["t", "node"]).select(
        "t", "src", F.col("node").alias("dst"),
        (F.abs(F.lit(alpha) * F.col("v")) / F.col("_dev") / (F.abs("pred_scaled") + F.lit(1e-6))).alias("risk")))
    top = r.agg(F.max("risk").alias("_top"))
    kept = F.when(F.col("src") == F.col("dst"), F.lit(1.0 if self_dampen is None else float(self_dampen))).otherwise(1.0)
    return r.crossJoin(F.broadcast(top)).select(
        "t", "src", "dst", (F.when(F.col("_top") > 0, F.col("risk") / F.col("_top")).otherwise(F.col("risk")) * kept).alias("risk"))


#: Nodes of a block of rows or columns, and middle nodes that are multiplied at a time.
BLOCK, MIDDLE = 2_048, 512


def _two_hops(left: pd.DataFrame, right: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Product over the middle nodes ``b`` that both have, and where it has a path."""
    total, paths = np.zeros((n, n)), np.zeros((n, n), np.float32)
    mid = np.intersect1d(left.b.to_numpy(), right.b.to_numpy())

    def dense(part: pd.DataFrame, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of one side that have any of these middle nodes, their weights and where there is one."""
        part = part[np.isin(part.b.to_numpy(), some)]
        own, row = np.unique(part.a.to_numpy(), return_inverse=True)
        w, there = np.zeros((len(own), len(some))), np.zeros((len(own), len(some)), np.float32)
        at = row, np.searchsorted(some, part.b.to_numpy())
        w[at], there[at] = part.w.to_numpy(), 1.0
        return own, w, there

    for first in range(0, len(mid), MIDDLE):
        (i, a, ia), (k, b, ib) = (dense(side, mid[first:first + MIDDLE]) for side in (left, right))
        total[np.ix_(i, k)] += a @ b.T
        paths[np.ix_(i, k)] += ia @ ib.T
    return total, paths > 0


#: Columns of the rows of a packed block; a block without any rows at a step.
_PACKED = ("t", "a", "b", "w", "u", "v", "name")
_NONE = pd.DataFrame({c: np.zeros(0, object if c == "name" else int if c in "tab" else float) for c in _PACKED})


def _columns(packed) -> dict:
    """The columns of the packed rows of a block, which is null if it has none."""
    return {c: _NONE[c].to_numpy() if packed is None or packed[c] is None else packed[c] for c in _PACKED}


def _risk_blocks(n: int, blocks: int, hop1: float, hop2: float, diagonal: bool, listed: bool):
    """Work on pairs of packed blocks: the largest risk of each pair, or the sums over t of every cell of it."""
    def step(pair: int, rows: list[pd.DataFrame], block: dict) -> None:
        left, right, z, base = rows
        bi, bk = divmod(pair, blocks)
        for side, part in (("i", base), ("k", z)):
            block[side][part.a.to_numpy()] = part.name.to_numpy()
        if base.empty:
            return
        cell, there = np.zeros((n, n)), np.zeros((n, n), bool)
        near = left[left.b.to_numpy() // n == bk]
        at = near.a.to_numpy(), near.b.to_numpy() % n
        cell[at], there[at] = near.w.to_numpy(), True
        two, paths = _two_hops(left, right, n)
        read, loop, own, scale, own_loop = (np.zeros(n) for _ in range(5))
        read[z.a.to_numpy()], loop[z.a.to_numpy()] = z.w.to_numpy(), z.u.to_numpy()
        scale[base.a.to_numpy()], own[base.a.to_numpy()], own_loop[base.a.to_numpy()] = base.w.to_numpy(), base.u.to_numpy(), base.v.to_numpy()
        value = (hop1 * cell + hop2 * (two + cell * loop[None, :] + cell * own_loop[:, None])) * read[None, :]
        known, told = np.zeros(n, bool), np.zeros(n, bool)
        known[z.a.to_numpy()], told[base.a.to_numpy()] = True, True
        there = (there | paths) & known[None, :] & told[:, None]
        if bi == bk:
            d = np.arange(n)
            value[d, d] += (hop1 * own_loop + hop2 * own_loop ** 2) * read + own
            there[d, d] = told & diagonal
        risk = np.where(there, np.abs(value) * scale[:, None], 0.0)
        block["top"] = max(block["top"], float(risk.max(initial=0.0)))
        if listed:
            block["s"] += risk
            block["ss"] += risk * risk
            block["seen"] |= there

    def told(pair: int, block: dict):
        bi, bk = divmod(pair, blocks)
        if not listed:
            yield pd.DataFrame({"top": [block["top"]]})
            return
        names = np.where(block["k"] == None, block["i"], block["k"]) if bi == bk else block["k"]  # noqa: E711
        for first in range(0, n, 64):
            i, k = np.nonzero(block["seen"][first:first + 64])
            yield pd.DataFrame({"src": names[k], "dst": block["i"][first + i], "s": block["s"][first + i, k], "ss": block["ss"][first + i, k]})

    def frames(kinds: list[int], packed) -> dict:
        """The rows of one block by kind and step."""
        out = {}
        for k, x in zip(kinds, packed, strict=True):
            d = pd.DataFrame({c: np.concatenate([np.zeros(0), x[c]]) if c != "name" else x[c] for c in x}).astype({"t": int, "a": int, "b": int})
            out[k] = dict(tuple(d.groupby("t")))
        return out

    def run(batches):
        for batch in batches:
            for x in batch.itertuples(index=False):
                parts = frames([0, 3], (_columns(x.near), _columns(x.base))) | frames([1, 2], (_columns(x.far), _columns(x.z)))
                pair = int(x.rb) * blocks + int(x.cb)
                block = {"top": 0.0, "i": np.full(n, None, object), "k": np.full(n, None, object)}
                if listed:
                    block |= {"s": np.zeros((n, n)), "ss": np.zeros((n, n)), "seen": np.zeros((n, n), bool)}
                for t in sorted(set().union(*parts.values())):
                    step(pair, [parts[k].get(t, _NONE) for k in range(4)], block)
                yield from told(pair, block)

    return run


def model_risk(
    edges: DataFrame, scaled: DataFrame, pred: DataFrame, coefficients: dict[str, float], alpha: float = 0.3, self_dampen: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(src, dst, risk, std): ``collapse_risk`` of ``model_perturbation`` over the steps of ``pred``, without a row for each pair and step.

    A task goes through the steps of one pair of blocks of nodes in order and adds up its cells.  Each block is packed and written
    once, and read by the tasks that need it, so the disk grows with the edges.  The result still has a row for each pair, and the time grows with their number.  Null
    values are not read.
    """
    a = row_normalize(edges.select("t", "src", "dst", "w"), ["t"]).groupBy("t", "src", "dst").agg(F.sum("w").alias("w"))
    z = scaled.filter(F.col("z").isNotNull()).select("t", "node", "z")
    dev = pred.groupBy("node").agg((F.stddev_pop("pred_scaled") + F.lit(1e-6)).alias("_dev"))
    own = F.lit(0.0)
    for c in [c for c in coefficients if c.startswith("lag")]:
        own = own + F.lit(coefficients[c]) * F.col(c)
    scale = F.abs(F.lit(alpha)) / F.col("_dev") / (F.abs("pred_scaled") + F.lit(1e-6))
    base = pred.join(dev, "node").select("node", F.col("prev").alias("t"), scale.alias("scale"), own.alias("own"))
    names = a.select(F.explode(F.array("src", "dst")).alias("node")).union(z.select("node")).union(base.select("node")).distinct()
    ids = stage(number_rows(names, [], [F.col("node")], "id").select("node", (F.col("id") - 1).alias("id")))
    count = ids.count()
    n = max(1, min(block, count))
    blocks = max(1, -(-count // n))

    def by_id(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(ids.select(F.col("node").alias(node), F.col("id").alias(name)), node)

    a = stage(by_id(by_id(a, "src", "i"), "dst", "k").select("t", "i", "k", "w"))
    off, loops = a.filter("i <> k"), a.filter("i = k").select("t", F.col("i").alias("id"), F.col("w").alias("loop"))
    z = by_id(z, "node", "id").join(loops, ["t", "id"], "left")
    base = by_id(base, "node", "id").join(loops, ["t", "id"], "left")
    no, nobody = F.lit(None).cast("double"), F.lit(None).cast("string")

    def part(df: DataFrame, kind: str, end: str, b: Column, w: str, u: Column, v: Column, name: Column) -> DataFrame:
        """Rows of ``df`` by the block that ``end`` is in."""
        days = F.coalesce(F.datediff("t", F.lit("1970-01-01").cast("date")), F.lit(-1_000_000))
        values = [days, (F.col(end) % n).cast("int"), b.cast("int"), F.col(w), u, v, name]
        return df.select(F.floor(F.col(end) / n).cast("int").alias("blk"), F.lit(kind).alias("kind"), F.struct(*[x.alias(c) for x, c in zip(values, _PACKED)]).alias("x"))

    def packed(blk: str, *parts: DataFrame) -> DataFrame:
        """One row for each block, with the rows of each kind by columns; a partition for each block."""
        g = parts[0].unionByName(parts[1]).groupBy("blk").pivot("kind", [kind for kind in kinds[blk]]).agg(F.collect_list("x"))
        one = [F.struct(*[F.col(f"{k}.{c}").alias(c) for c in _PACKED]).alias(k) for k in kinds[blk]]
        return stage(g.select(F.col("blk").alias(blk), *one).repartitionByRange(blocks, blk))

    kinds = {"rb": ("near", "base"), "cb": ("far", "z")}
    loop = F.coalesce("loop", F.lit(0.0))
    rows = packed("rb", part(off, "near", "i", F.col("k"), "w", no, no, nobody),
                  part(base, "base", "id", F.lit(-1), "scale", F.col("own"), loop, F.col("node")))
    cols = packed("cb", part(off, "far", "k", F.col("i"), "w", no, no, nobody),
                  part(z, "z", "id", F.lit(-1), "z", loop, no, F.col("node")))
    # each pair of blocks is a task, run twice: once for the largest risk, which scales all
    rows = rows.hint("shuffle_replicate_nl").crossJoin(cols)
    hop1, hop2 = coefficients.get("hop1", 0.0), coefficients.get("hop2", 0.0)

    def work(listed: bool):
        return _risk_blocks(n, blocks, hop1, hop2, self_dampen is not None, listed)

    top = rows.mapInPandas(work(False), "top double").agg(F.max("top")).first()[0] or 1.0
    steps = pred.select("t").distinct().count()
    kept = F.when(F.col("src") == F.col("dst"), F.lit(1.0 if self_dampen is None else float(self_dampen))).otherwise(1.0) / F.lit(top)
    g = rows.mapInPandas(work(True), "src string, dst string, s double, ss double").select(
        "src", "dst", (F.col("s") * kept).alias("s"), (F.col("ss") * kept * kept).alias("ss"))
    var = ratio(F.col("ss") - F.col("s") * F.col("s") / F.lit(steps), F.lit(float(steps - 1)))
    return g.select("src", "dst", (F.col("s") / F.lit(steps)).alias("risk"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def collapse_risk(timewise: DataFrame, steps: DataFrame) -> DataFrame:
    """Mean and sample deviation over all steps; steps without an edge count as zero."""
    n = steps.select("t").distinct().agg(F.count(F.lit(1)).alias("_n"))
    g = timewise.groupBy("src", "dst").agg(F.sum("risk").alias("s"), F.sum(F.col("risk") * F.col("risk")).alias("ss"))
    var = ratio(F.col("ss") - F.col("s") * F.col("s") / F.col("_n"), (F.col("_n") - 1).cast("double"))
    return g.crossJoin(F.broadcast(n)).select(
        "src", "dst", (F.col("s") / F.col("_n")).alias("risk"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def consensus(raw: DataFrame, trend: DataFrame, rule: str = "min") -> DataFrame:
    """Combine two timewise risks and measure their agreement."""
    j = raw.select("t", "src", "dst", F.col("risk").alias("a")).join(
        trend.select("t", "src", "dst", F.col("risk").alias("b")), ["t", "src", "dst"], "full").fillna(0.0, ["a", "b"])
    a, b = F.col("a"), F.col("b")
    value = {
        "min": F.least(a, b), "geom": F.sqrt(F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0))), "mean": (a + b) / 2,
    }[rule]
    return j.select("t", "src", "dst", value.alias("risk"),
                    (1 - F.abs(a - b) / (F.greatest(a, b) + F.lit(1e-9))).alias("agree"))


def collapse_consensus(both: DataFrame, steps: DataFrame) -> DataFrame:
    """Mean risk, deviation and agreement over steps; an absent step agrees fully (zero and zero)."""
    n = steps.select("t").distinct().agg(F.count(F.lit(1)).alias("_n"))
    agree = both.groupBy("src", "dst").agg(F.sum("agree").alias("_a"), F.count(F.lit(1)).alias("_k"))
    agree = agree.crossJoin(F.broadcast(n)).select("src", "dst", ((F.col("_a") + F.col("_n") - F.col("_k")) / F.col("_n")).alias("agree"))
    return collapse_risk(both, steps).join(agree, ["src", "dst"])


def _moments(x: Column, y: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    ]


def _r() -> Column:
    return pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def risk_signal_corr(timewise: DataFrame, signal: DataFrame, mode: str = "target", min_pairs: int = 2) -> DataFrame:
    """|Pearson| over time of risk src -> dst with the signal of dst (target) or src (source).

    Steps where a pair has no edge are zero risk: they enter through the signal's own totals.
    """
    end = "dst" if mode == "target" else "src"
    s = signal.filter(F.col("x").isNotNull()).select("t", F.col("node").alias(end), F.col("x").alias("y"))
    whole = s.groupBy(end).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    x, y = F.col("risk"), F.col("y")
    g = timewise.join(s, ["t", end]).groupBy("src", "dst").agg(
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    r = F.when(F.col("n") >= min_pairs, F.abs(_r()))
    return g.join(whole, end).select("src", "dst", F.coalesce(r, F.lit(0.0)).alias("corr"))


def _block_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Moments of all row pairs of two node blocks over one span of time."""
    left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
    steps = np.unique(pdf.t.to_numpy())

    def dense(part: pd.DataFrame):
        names, row = np.unique(part.node.to_numpy(), return_inverse=True)
        col = np.searchsorted(steps, part.t.to_numpy())
        x, m = np.zeros((len(names), len(steps))), np.zeros((len(names), len(steps)))
        x[row, col] = part.x.to_numpy()
        m[row, col] = 1.0
        return names, x, m

    ni, xi, mi = dense(left)
    nj, xj, mj = dense(right)
    parts = [mi @ mj.T, xi @ mj.T, mi @ xj.T, (xi * xi) @ mj.T, mi @ (xj * xj).T, xi @ xj.T]
    a, b = np.meshgrid(ni, nj, indexing="ij")
    keep = (a < b) & (parts[0] > 0)
    out = {"i": a[keep], "j": b[keep]}
    out.update({k: p[keep] for k, p in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), parts)})
    return pd.DataFrame(out)


def series_corr(series: DataFrame, block: int = 256, span_days: int = 3650) -> DataFrame:
    """|Pearson| of every pair of node series over their common steps; constant or empty gives 0.

    Nodes are numbered into blocks of fixed size.  A task holds two blocks over one span of
    time and gets all their moments from matrix products; spans are added up afterwards.
    """
    s = series.filter(F.col("x").isNotNull()).select("t", "node", "x")
    num = number_rows(s.select("node").distinct(), [], [F.col("node")], "_i")
    num = stage(num.select("node", F.floor((F.col("_i") - 1) / block).cast("int").alias("blk")))
    last = num.agg(F.max("blk").alias("last"))
    d = s.join(num, "node").crossJoin(F.broadcast(last)).select(
        F.datediff("t", F.lit("1970-01-01").cast("date")).alias("t"), "node", "x", "blk", "last")
    d = d.withColumn("span", F.floor(F.col("t") / span_days).cast("int"))
    left = d.select("t", "node", "x", "span", F.lit(0).alias("side"), F.col("blk").alias("bi"),
                    F.explode(F.sequence("blk", "last")).alias("bj"))
    right = d.select("t", "node", "x", "span", F.lit(1).alias("side"),
                     F.explode(F.sequence(F.lit(0), "blk")).alias("bi"), F.col("blk").alias("bj"))
    schema = "i string, j string, n double, sx double, sy double, sxx double, syy double, sxy double"
    m = left.unionByName(right).groupBy("bi", "bj", "span").applyInPandas(_block_moments, schema)
    g = m.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return g.select("i", "j", F.coalesce(F.abs(_r()), F.lit(0.0)).alias("corr"))


def pair_corr(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """|Pearson| (i, j, corr) of the pairs (i, j) asked for, over their common steps; other pairs are not computed."""
    s = series.filter(F.col("x").isNotNull()).select("t", "node", "x")
    left = pairs.select("i", "j").distinct().join(s.withColumnRenamed("node", "i"), "i")
    both = left.join(s.select("t", F.col("node").alias("j"), F.col("x").alias("y")), ["t", "j"])
    g = both.groupBy("i", "j").agg(*_moments(F.col("x"), F.col("y")))
    return g.select("i", "j", F.coalesce(F.abs(_r()), F.lit(0.0)).alias("corr"))


def flow_reference(static: DataFrame, sym: str = "mean", gamma: float = 1.0, min_q: float | None = None) -> DataFrame:
    """Symmetric flow with zero diagonal, weak edges cut, power and scaling to the maximum."""
    off = static.filter(F.col("src") != F.col("dst"))
    both = off.select("src", "dst", "w").unionByName(off.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    fold = {"mean": F.sum("w") / 2, "sum": F.sum("w"), "max": F.max("w")}[sym]
    f = stage(both.groupBy("src", "dst").agg(fold.alias("w")).filter(F.col("w") > 0))
    if min_q is not None:
        q = exact_quantiles(f, [], "w", {"q": min_q})
        f = f.crossJoin(F.broadcast(q)).filter(F.col("w") >= F.col("q")).drop("q")
    f = f.withColumn("w", F.pow("w", F.lit(float(gamma))))
    top = f.agg(F.max("w").alias("_m"))
    return f.crossJoin(F.broadcast(top)).select("src", "dst", ratio(F.col("w"), F.col("_m")).alias("w"))


def corr_x_mobility(corr: DataFrame, flow: DataFrame) -> DataFrame:
    """Correlation x flow on the flow's edges, rows normalised."""
    sym = corr.select(F.col("i").alias("src"), F.col("j").alias("dst"), "corr").unionByName(
        corr.select(F.col("j").alias("src"), F.col("i").alias("dst"), "corr"))
    return row_normalize(flow.join(sym, ["src", "dst"]).select("src", "dst", (F.col("w") * F.col("corr")).alias("w")))


def flow_risk_corr(risk: DataFrame, flow: DataFrame, n: DataFrame) -> DataFrame:
    """Pearson of risk and flow over the upper triangle; missing cells are zeros.

    ``n``: one row with the number of nodes, which fixes the number of cells.
    """
    up = F.col("src") < F.col("dst")
    j = risk.filter(up).select("src", "dst", F.col("risk").alias("x")).join(
        flow.filter(up).select("src", "dst", F.col("w").alias("y")), ["src", "dst"], "full").fillna(0.0, ["x", "y"])
    g = j.agg(*_moments(F.col("x"), F.col("y"))[1:]).crossJoin(F.broadcast(n))
    g = g.withColumn("n", (F.col("n") * (F.col("n") - 1) / 2).cast("double"))
    return g.select(F.col("n").cast("long").alias("cells"), _r().alias("corr"))


def proxy_corr(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson between two proxies (i, j, corr) over the pairs they share."""
    j = a.select("i", "j", F.col("corr").alias("x")).join(b.select("i", "j", F.col("corr").alias("y")), ["i", "j"])
    return j.agg(*_moments(F.col("x"), F.col("y"))).select(F.col("n").cast("long").alias("cells"), _r().alias("corr"))


def passes_gate(corr: DataFrame, floor: float = 0.40) -> bool:
    row = corr.first()
    return row is not None and row["corr"] is not None and row["corr"] >= floor


def stable_mask(risk: DataFrame, min_agree: float = 0.70, q: float = 0.80) -> DataFrame:
    """Cells with enough agreement and a deviation up to its q-quantile."""
    lim = exact_quantiles(risk, [], "std", {"_lim": q})
    return risk.crossJoin(F.broadcast(lim)).filter((F.col("agree") >= min_agree) & (F.col("std") <= F.col("_lim"))).drop("_lim")


def flow_mask(risk: DataFrame, flow: DataFrame, threshold: float) -> DataFrame:
    """Variant: cells whose row-normalised flow reaches a threshold."""
    keep = row_normalize(flow).filter(F.col("w") >= threshold).select("src", "dst")
    return risk.join(keep, ["src", "dst"], "left_semi")


def rank_in_out(risk: DataFrame, flow: DataFrame, population: DataFrame, tau: float = 0.02, q: float = 0.80) -> DataFrame:
    """Outbound (site -> county) and inbound (county -> site) scores per site.

    Cell weight = stability x row-normalised flow x population / mean on both ends.
    ``population``: (node, population).
    """
    kind = F.when(F.col("src").startswith("W_") & F.col("dst").startswith("C_"), "out").when(
        F.col("src").startswith("C_") & F.col("dst").startswith("W_"), "in")
    r = stage(risk.withColumn("block", kind).filter(F.col("block").isNotNull()))
    lim = exact_quantiles(r, ["block"], "std", {"_q": q})
    p = population.withColumn("kind", F.substring("node", 1, 1))
    mean = p.groupBy("kind").agg(F.avg("population").alias("_mean"))
    scaled = p.join(F.broadcast(mean), "kind").select("node", ratio(F.col("population"), F.col("_mean")).alias("pw"))
    f = row_normalize(flow.filter(F.col("src") != F.col("dst")).select("src", "dst", "w")).select("src", "dst", F.col("w").alias("_flow"))
    d = (
        r.join(F.broadcast(lim), "block").join(f, ["src", "dst"], "left")
        .join(scaled.select(F.col("node").alias("src"), F.col("pw").alias("_ps")), "src", "left")
        .join(scaled.select(F.col("node").alias("dst"), F.col("pw").alias("_pd")), "dst", "left")
    )
    one = F.lit(1.0)
    stab = F.col("agree") * (1 - clip(F.coalesce(ratio(F.col("std"), F.col("_q")), F.lit(0.0)), 0.0, 1.0))
    d = d.withColumn("wr", F.col("risk") * stab * F.coalesce("_flow", F.lit(0.0)) * F.coalesce("_ps", one) * F.coalesce("_pd", one))
    rows = d.groupBy("block", "src").agg(F.sum("risk").alias("_s"), F.sum("wr").alias("_w"))
    d = d.join(rows, ["block", "src"]).withColumns({
        "rn": F.coalesce(ratio(F.col("risk"), F.col("_s")), F.lit(0.0)), "wn": F.coalesce(ratio(F.col("wr"), F.col("_w")), F.lit(0.0))})
    site = F.when(F.col("block") == "out", F.col("src")).otherwise(F.col("dst"))
    return d.groupBy("block", site.alias("node")).agg(
        F.sum("rn").alias("score_unweighted"), F.sum("wn").alias("score_weighted"), F.count_if(F.col("rn") >= tau).alias("diversity"))


def rank_raw(risk: DataFrame, k: int) -> DataFrame:
    """Sites by total outbound risk."""
    g = risk.filter(F.col("src").startswith("W_") & (F.col("src") != F.col("dst"))).groupBy("src").agg(F.sum("risk").alias("score"))
    return top_rows(g, [F.round("score", 9).desc(), F.col("src")], k, "rank").select("rank", F.col("src").alias("node"), "score")


def rank_self(risk: DataFrame, k: int) -> DataFrame:
    """Sites by their own diagonal."""
    g = risk.filter(F.col("src").startswith("W_") & (F.col("src") == F.col("dst"))).select("src", F.col("risk").alias("score"))
    return top_rows(g, [F.round("score", 9).desc(), F.col("src")], k, "rank").select("rank", F.col("src").alias("node"), "score")


def top_edges(edges: DataFrame, value: str, k: int, undirected: bool = False) -> DataFrame:
    """k strongest off-diagonal pairs."""
    e = edges.filter(F.col("src") < F.col("dst") if undirected else F.col("src") != F.col("dst"))
    return top_rows(e, [F.round(value, 9).desc(), F.col("src"), F.col("dst")], k, "rank").select("rank", "src", "dst", value)


def quantile_edges(edges: DataFrame, value: str, q: float = 0.97, limit: int = 200) -> DataFrame:
    """Edges at or above a quantile of the positive values, strongest first."""
    pos = stage(edges.filter((F.col(value) > 0) & (F.col("src") != F.col("dst"))))
    lim = exact_quantiles(pos, [], value, {"_lim": q})
    return top_edges(pos.crossJoin(F.broadcast(lim)).filter(F.col(value) >= F.col("_lim")), value, limit)


def top_block(edges: DataFrame, value: str, sites: int, counties: int) -> DataFrame:
    """The strongest sites and, for each, its strongest counties."""
    e = edges.filter(F.col("src").startswith("W_") & F.col("dst").startswith("C_"))
    s = top_rows(e.groupBy("src").agg(F.sum(value).alias("_s")), [F.round("_s", 9).desc(), F.col("src")], sites)
    w = Window.partitionBy("src").orderBy(F.round(value, 9).desc(), "dst")
    return e.join(F.broadcast(s.select("src")), "src").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= counties).select(
        "src", "rank", "dst", value)


def degree_stats(edges: DataFrame, n: DataFrame) -> DataFrame:
    """Non-zero in- and out-degree per node and the non-zero share of the matrix."""
    e = edges.filter((F.col("w") != 0) & (F.col("src") != F.col("dst")))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                      F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("p"))
    deg = ends.groupBy("p.node").agg(F.sum("p.o").alias("out_degree"), F.sum("p.i").alias("in_degree"))
    share = e.agg(F.count(F.lit(1)).alias("_nz")).crossJoin(F.broadcast(n)).select(
        (F.col("_nz") / (F.col("n") * (F.col("n") - 1))).alias("nonzero_frac"))
    return deg.crossJoin(F.broadcast(share))


def _bins(df: DataFrame, parts: list[str], value: str, q: int, name: str) -> DataFrame:
    """Quantile bins 0..q-1, right-closed; equal break points merge."""
    names = {f"_q{i}": i / q for i in range(1, q)}
    lims = exact_quantiles(df, parts, value, names)
    d = df.join(lims, parts) if parts else df.crossJoin(F.broadcast(lims))
    lo = df.groupBy(*parts).agg(F.min(value).alias("_lo"))
    d = d.join(lo, parts) if parts else d.crossJoin(F.broadcast(lo))
    cuts = F.array_distinct(F.filter(F.array(*[F.round(c, 9) for c in names]), lambda c: c > F.round(F.col("_lo"), 9)))
    at = F.size(F.filter(cuts, lambda c: F.round(F.col(value), 9) > c))
    return d.withColumn(name, at).drop(*names, "_lo")


def series_groups(pred: DataFrame, q_span: int = 2, q_center: int = 3) -> DataFrame:
    """Nodes grouped by the range, then by the level, of smoothed truth and prediction."""
    w = Window.partitionBy("node").orderBy("t").rowsBetween(-1, 1)
    d = pred.withColumn("_s", F.avg("truth").over(w))
    hi, lo = F.max(F.greatest("_s", "pred")), F.min(F.least("_s", "pred"))
    g = stage(d.groupBy("node").agg((hi - lo).alias("span"), ((hi + lo) / 2).alias("center")))
    g = stage(_bins(g, [], "span", q_span, "span_bin"))
    return _bins(g, ["span_bin"], "center", q_center, "center_bin").select("node", "span", "center", "span_bin", "center_bin")


def cluster_sites(affinity: DataFrame, k: int, q: float = 0.5, max_iter: int = 15) -> DataFrame:
    """Spectral-style clusters of (i, j, w) by power iteration on the strong edges."""
    pos = stage(affinity.filter(F.col("w") > 0))
    lim = exact_quantiles(pos, [], "w", {"_lim": q})
    strong = stage(pos.crossJoin(F.broadcast(lim)).filter(F.col("w") >= F.col("_lim")).select("i", "j", "w"))
    ids = stage(number_rows(strong.select(F.col("i").alias("node")).union(strong.select("j")).distinct(), [], [F.col("node")], "id"))
    e = strong.join(ids.select(F.col("node").alias("i"), F.col("id").alias("src")), "i").join(
        ids.select(F.col("node").alias("j"), F.col("id").alias("dst")), "j").select("src", "dst", F.col("w").alias("weight"))
    return cluster_edges(e, ids, k, max_iter)


def cluster_edges(edges: DataFrame, ids: DataFrame, k: int, max_iter: int = 15) -> DataFrame:
    """Clusters of the nodes (node, id) by power iteration on edges (src, dst, weight) between ids."""
    pic = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight")
    return pic.assignClusters(edges).join(ids, "id").select("node", "cluster")


def best_run(grid: DataFrame, disease: str, mode: str, n: int = 1) -> DataFrame:
    """Best logged run: correlation down, held-out errors up, newest first."""
    g = grid.filter((F.lower("disease") == disease.lower()) & (F.lower("mode") == mode.lower()) & F.col("corr").isNotNull())
    return g.orderBy(F.desc("corr"), F.asc_nulls_last("rmse"), F.asc_nulls_last("mae"), F.desc("time"), "tag").limit(n)


def run_grid(spark, params: dict[str, list]) -> DataFrame:
    """Every combination of the parameter lists with a tag per run."""
    out = spark.range(1)
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id").withColumn("tag", F.concat_ws("_", *[F.concat(F.lit(n), F.col(n).cast("string")) for n in params]))


def log_runs(configs: list[dict], metrics: list[dict], spark) -> DataFrame:
    """One row per finished run."""
    rows = [dict(c, **m) for c, m in zip(configs, metrics)]
    return spark.createDataFrame(pd.DataFrame(rows))


