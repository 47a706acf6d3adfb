r"""Mixing sources to target weights by hierarchical budgets over a domain, language and source tree.

A token budget goes down the tree. At each node it is shared among the children by weight, but no child gets more than
its subtree can give (its tokens times ``max_epochs``); what one child cannot take goes to its siblings by their weights.
Only when all siblings are full does a shortage reach the parent's siblings. Each leaf then reads its texts in a seeded
order, anew for each epoch: whole epochs first, then of one more the longest prefix that stays within its budget.

The domain of a text is given by an SQL expression over ``lang`` and ``source``; the default groups numbered sources by
fives. Null language or source is a value of its own, ``''``. A child without a weight has weight 1; weight 0 gives
nothing. Tokens are words between white space; a null or blank text has 0 tokens and is chosen with its leaf's whole
epochs, or where its place in the order is before the prefix's end. Repeated rows and equal ids share their place: they
are taken together or not at all. Other columns pass through ``mix_documents`` untouched. An empty table gives no rows.

Order within a leaf is that of md5(seed:epoch:doc_id). To find where a prefix ends no leaf is sorted as a whole: tokens
are summed over 256 x 256 ranges of the first four digits, and only rows in the range where the budget ends are ordered.
So the choice is one comparison per row with its leaf's end, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.llm.common import small, stage, text_or_empty

DOMAIN = r"coalesce(concat('d', floor(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS DOUBLE) / 5)), 'other')"
#: Default weights: a node's key below its parent, as (domain), (domain, lang) or (domain, lang, source).
WEIGHTS = {
    ("d0",): 4.0, ("d1",): 2.0, ("d2",): 2.0, ("d3",): 1.0,
    ("d0", "en"): 3.0, ("d1", "en"): 2.0, ("d2", "en"): 2.0, ("d3", "en"): 2.0,
    ("d0", "en", "src0"): 2.0, ("d0", "en", "src1"): 0.5,
}
LEAF = ["domain", "lang", "source"]


def words() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def leaf_columns(domain: str) -> list[Column]:
    lang, source = F.coalesce(F.col("lang"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))
    return [F.coalesce(F.expr(domain).cast("string"), F.lit("")).alias("domain"), lang.alias("lang"), source.alias("source")]


def place(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def weight(weights: dict[tuple, float], depth: int) -> Column:
    found = [(k, w) for k, w in weights.items() if len(k) == depth]
    value = F.lit(1.0)
    for key, w in found:
        hit = F.lit(True)
        for column, x in zip(LEAF, key, strict=False):
            hit = hit & (F.col(column) == x)
        value = F.when(hit, float(w)).otherwise(value)
    return value


def share(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight``, none above its ``room``, as the column ``given``.

    Children in order of room / weight: the first k are full where the level that the others reach, (budget - their
    room) / (weight of the others), is above their own.
    """
    order = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ranked = nodes.where("weight > 0 AND room > 0").withColumn("ratio", F.col("room") / F.col("weight"))
    before = order.orderBy("ratio", key).rowsBetween(Window.unboundedPreceding, -1)
    onward = order.orderBy("ratio", key).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    top = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", key, "level"))).over(order)["level"]
    level = F.coalesce(top, F.lit(float("inf")))
    return levels.withColumn("given", F.greatest(F.lit(0.0), F.least("room", level * F.col("weight")))).drop("ratio", "level", "weight", "budget")


def budgets(supply: DataFrame, weights: dict[tuple, float], budget: Column, max_epochs: int) -> DataFrame:
    """(domain, lang, source, supply, target) from each leaf's supply of tokens; ``budget`` is an aggregate over it."""
    room = supply.withColumn("room", F.col("supply") * F.lit(float(max_epochs)))
    total = supply.agg(budget.cast("double").alias("budget"))
    at_domain = room.groupBy("domain").agg(F.sum("room").alias("room")).withColumn("weight", weight(weights, 1)).crossJoin(F.broadcast(total))
    at_domain = share(at_domain, [], "domain").select("domain", F.col("given").alias("budget"))
    at_lang = room.groupBy("domain", "lang").agg(F.sum("room").alias("room")).withColumn("weight", weight(weights, 2)).join(at_domain, "domain")
    at_lang = share(at_lang, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    leaves = room.withColumn("weight", weight(weights, 3)).join(at_lang, ["domain", "lang"])
    leaves = share(leaves, ["domain", "lang"], "source").select(*LEAF, F.col("given").alias("target"))
    return supply.join(leaves, LEAF, "left").withColumn("target", F.coalesce("target", F.lit(0.0)))


def plan(docs: DataFrame, weights: dict[tuple, float], fraction: float, max_epochs: int, seed: int, domain: str) -> DataFrame:
    """Each leaf's whole epochs (``full``) and where the prefix of the next one ends (``last``, null for none)."""
    slim = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(domain), words().alias("tokens")), "mix-rows")
    supply = slim.groupBy(*LEAF).agg(F.sum("tokens").alias("supply"), F.count("*").alias("docs"))
    target = budgets(supply, weights, F.floor(F.sum("supply") * F.lit(fraction)), max_epochs)
    # one ten-thousandth of a token absorbs rounding of doubles before whole epochs are counted
    full = F.when(F.col("supply") > 0, F.least(F.floor((F.col("target") + 1e-4) / F.col("supply")), F.lit(max_epochs))).otherwise(0)
    target = target.withColumn("full", full.cast("int")).withColumn("rest", F.floor(F.col("target") + 1e-4).cast("long") - F.col("full") * F.col("supply"))
    target = stage(target, "mix-leaves")
    open_ = target.where(F.col("rest") > 0).select(*LEAF, "full", "rest")
    placed = slim.join(small(open_), LEAF).withColumn("place", place(seed, F.col("full")))
    placed = placed.withColumns({"coarse": F.substring("place", 1, 2), "fine": F.substring("place", 3, 2)})
    cells = stage(placed.groupBy(*LEAF, "rest", "coarse", "fine").agg(F.sum("tokens").alias("tokens")), "mix-cells")
    by_fine = Window.partitionBy(*LEAF, "coarse").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    by_coarse = Window.partitionBy(*LEAF).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = cells.groupBy(*LEAF, "rest", "coarse").agg(F.sum("tokens").alias("tokens"))
    coarse = coarse.withColumn("before", F.coalesce(F.sum("tokens").over(by_coarse), F.lit(0)))
    # the range in which the budget ends: it starts within the budget and ends beyond it
    coarse = coarse.where("before <= rest AND before + tokens > rest").select(*LEAF, "coarse", "before")
    fine = cells.join(small(stage(coarse, "mix-coarse")), [*LEAF, "coarse"])
    fine = fine.withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(by_fine), F.lit(0)))
    fine = stage(fine.where("before <= rest AND before + tokens > rest").select(*LEAF, "rest", "coarse", "fine", "before"), "mix-fine")
    row = Window.partitionBy(*LEAF, "coarse", "fine").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.drop("rest").join(small(fine), [*LEAF, "coarse", "fine"]).withColumn("upto", F.col("before") + F.sum("tokens").over(row))
    # the first place beyond the budget: everything before it is in the prefix
    stop = inside.where("upto > rest").groupBy(*LEAF).agg(F.min("place").alias("stop"))
    return stage(target.join(stop, LEAF, "left"), "mix-plan")


def selected(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with leaf columns and doc_id) once for each epoch that takes them, with ``epoch`` added."""
    rest = (F.col("rest") > 0) & (place(seed, F.col("full")) < F.coalesce("stop", F.lit("g")))
    times = F.col("full") + rest.cast("int")
    with_leaf = rows.join(small(leaves.select(*LEAF, "full", "rest", "stop")), LEAF).withColumn("_times", times).where("_times > 0")
    return with_leaf.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times", "full", "rest", "stop")


def mix(docs: DataFrame, weights: dict[tuple, float] = WEIGHTS, fraction: float = 0.8, max_epochs: int = 2, seed: int = 7, domain: str = DOMAIN) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens) of every text for every epoch that takes it."""
    leaves = plan(docs, weights, fraction, max_epochs, seed, domain)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(domain), words().alias("tokens"))
    return selected(rows, leaves, seed).select("doc_id", *LEAF, "epoch", "tokens")


def mix_documents(docs: DataFrame, weights: dict[tuple, float] = WEIGHTS, fraction: float = 0.8, max_epochs: int = 1, seed: int = 7, domain: str = DOMAIN) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, a row for each epoch."""
    leaves = plan(docs, weights, fraction, max_epochs, seed, domain)
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(domain))
    return selected(packed, leaves, seed).select("_row.*")


def sql(weights: dict[tuple, float] = WEIGHTS, fraction: float = 0.8, max_epochs: int = 2, seed: int = 7) -> str:
    """DuckDB's form of ``mix`` over ``documents`` with the default domain."""
    def case(depth: int) -> str:
        # a later entry wins in neither form: keys are distinct
        whens = " ".join(
            "WHEN " + " AND ".join(f"{c} = '{x}'" for c, x in zip(LEAF, key, strict=False)) + f" THEN {w!r}::DOUBLE"
            for key, w in weights.items() if len(key) == depth
        )
        return f"CASE {whens} ELSE 1.0::DOUBLE END" if whens else "1.0::DOUBLE"

    def level(name: str, source: str, parent: str, key: str) -> str:
        over = f"PARTITION BY {parent}" if parent else ""
        keys = f"{parent}, {key}" if parent else key
        return f"""
{name}_l AS (SELECT *, room / weight AS ratio,
  (budget - coalesce(sum(room) OVER ({over} ORDER BY room / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER ({over} ORDER BY room / weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ({source}) WHERE weight > 0 AND room > 0),
{name} AS (SELECT {keys}, greatest(0.0, least(room, weight * coalesce(
  first_value(CASE WHEN level <= ratio THEN level END IGNORE NULLS) OVER ({over} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
  'infinity'::DOUBLE))) AS budget FROM {name}_l)"""

    return rf"""
WITH s AS (SELECT doc_id, coalesce('d' || CAST(floor(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS DOUBLE) / 5) AS BIGINT), 'other') AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
supply AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, sum(tokens) * {float(max_epochs)!r}::DOUBLE AS room FROM s GROUP BY ALL),
{level("a", f"SELECT domain, sum(room) AS room, {case(1)} AS weight, (SELECT floor(sum(supply) * {fraction!r}::DOUBLE) FROM supply) AS budget FROM supply GROUP BY domain", "", "domain")},
{level("b", f"SELECT domain, lang, room, {case(2)} AS weight, budget FROM (SELECT domain, lang, sum(room) AS room FROM supply GROUP BY ALL) JOIN a USING (domain)", "domain", "lang")},
{level("c", f"SELECT domain, lang, source, room, {case(3)} AS weight, budget FROM supply JOIN b USING (domain, lang)", "domain, lang", "source")},
t AS (SELECT domain, lang, source, supply, coalesce(budget, 0.0) AS target,
  CASE WHEN supply > 0 THEN least(CAST(floor((coalesce(budget, 0.0) + 1e-4) / supply) AS BIGINT), {max_epochs}) ELSE 0 END AS whole
  FROM supply LEFT JOIN c USING (domain, lang, source)),
p AS (SELECT s.*, whole, CAST(floor(target + 1e-4) AS BIGINT) - whole * supply AS rest, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM s JOIN t USING (domain, lang, source)),
q AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM p),
r AS (SELECT *, min(CASE WHEN upto > rest THEN place END) OVER (PARTITION BY domain, lang, source) AS stop FROM q)
SELECT doc_id, domain, lang, source, CAST(unnest(range(whole + CASE WHEN rest > 0 AND place < coalesce(stop, 'g') THEN 1 ELSE 0 END)) AS INTEGER) AS epoch, tokens FROM r
"""
