"""Merkle manifest of a dataset: stored tree levels, and a recursive query that climbs from every row to the root.

Every row is a leaf, the SHA-256 of its columns. Leaves of a source ascend by doc_id; every ``FAN`` consecutive nodes have
a parent, the SHA-256 of their digests, until the source has one node, its subroot; subroots, ordered by source, have
parents in the same way up to the root. ``build`` writes the levels as parent-linked rows, and ``climb`` ascends by a
recursive query that collects siblings and folds a leaf's (possibly changed) digest with them up to a root to compare.

The leaves of one run share all siblings above them, so a climbing row carries a run: the digests of its leaves that
differ, each folded, and the siblings once. A node row holds its children's digests, and is stored once for every slice of ``SLICE``
leaves below it; a climbing row meets the copy of its own slice, so no join key has more rows than a slice has runs.

Nulls have a digest of their own (``-``), come first in every order and are climbed like other rows; a row without an id
is never tampered with. Rows with equal ids and source are ordered by their leaves; repeated rows are leaves each. The empty
table has no rows and no root. Texts may be of any length; other columns are ignored. All positions come from a range
partitioning and the sizes of its partitions, so no source is brought together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.llm.common import stage

#: Children of a node, and leaves below one stored copy of a node.
FAN, SLICE = 16, 1 << 16
#: Levels of the tree of subroots are numbered from here; a source's own tree has fewer.
TOP = 32
#: Bits of a leaf's position in a node's number.
AT = 50
DIGEST = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(data: Column) -> Column:
    """SHA-256 of the digests in ``data`` (bytes) as hex text; as bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(data)), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 over the columns, each ``-`` if null, else its length in bytes, a colon and its value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in columns.values()]), 256))


def node_number(level: Column, first: Column) -> Column:
    """The number of the node of a level whose first leaf is ``first``."""
    return F.shiftleft(level.cast("long"), AT) + first


@dataclass
class Manifest:
    """``runs``: the lowest nodes with their leaves; ``nodes``: all nodes above, parent-linked; ``root``: one row or none."""

    runs: DataFrame
    nodes: DataFrame
    root: DataFrame


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows``, staged, with their positions from 0 in ``order``, nulls first: sizes of range partitions are added up."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stage(ordered.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_p", before.alias("_before")))
    placed = ordered.withColumn("_p", part).join(offsets, "_p").withColumn(name, F.col("_before") + inside)
    return placed.drop("_m", "_before")


def parents(children: DataFrame, keys: list[str], group: Column, level: int) -> DataFrame:
    """Nodes of every ``FAN`` rows of ``children`` (pos, digest, first, last) by ``keys`` and ``group``."""
    found = children.groupBy(*keys, group.alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("_c"), F.min("first").alias("first"), F.max("last").alias("last"))
    joined = F.aggregate("_c", F.lit(b""), lambda all_, c: F.concat(all_, c.digest))
    found = found.withColumn("children", joined).withColumn("digest", h(F.col("children"))).withColumnRenamed("_group", "pos")
    return found.select(*keys, F.lit(level).alias("level"), "pos", "first", "last", "children", "digest")


def build(leaves: DataFrame) -> Manifest:
    """The tree over ``leaves`` (doc_id, source, leaf, changed), ``changed`` being a digest to climb with or null."""
    # equal sources form one stretch; a source's start is found from the starts within each partition
    placed = numbered(leaves, ["source", "doc_id", "leaf"], "g")
    stretches = placed.groupBy("_p", "source").agg(F.min("g").alias("low"), F.count("*").alias("n"))
    sources = stage(stretches.groupBy("source").agg(F.min("low").alias("start"), F.sum("n").alias("n")), "sources")
    starts = stretches.join(sources.withColumnRenamed("source", "_s").withColumnRenamed("n", "_n"), F.col("source").eqNullSafe(F.col("_s")))
    starts = starts.select(F.col("_p").alias("_q"), F.col("source").alias("_s"), "start", F.col("_n").alias("n"))
    placed = placed.join(starts, (F.col("_p") == F.col("_q")) & F.col("source").eqNullSafe(F.col("_s")))
    pos = F.col("g") - F.col("start")
    low = F.col("start") + F.floor(pos / FAN) * FAN
    runs = placed.groupBy(low.alias("first"), "start", "n").agg(
        F.array_sort(F.collect_list(F.struct("g", "doc_id", "leaf", "changed"))).alias("leaves"))
    together = F.aggregate("leaves", F.lit(b""), lambda all_, x: F.concat(all_, x.leaf))
    alone = F.col("n") == 1
    runs = stage(
        runs.withColumn("children", together)
        .withColumn("digest", F.when(alone, F.col("children")).otherwise(h(F.col("children"))))
        .withColumn("last", F.col("first") + F.size("leaves")), "runs")

    # a source's levels above the runs; ``width`` counts its nodes of the level
    width = F.ceil(F.col("n") / FAN)
    level = runs.select("start", width.alias("width"), ((F.col("first") - F.col("start")) / FAN).cast("long").alias("pos"), "first", "last", "digest")
    widest, tops, nodes, k = (runs.agg(F.max(width)).first()[0] or 0), [level.where("width = 1")], [], 1
    while widest > 1:
        k, widest = k + 1, -(-widest // FAN)
        up = stage(parents(level.where("width > 1"), ["start", "width"], F.floor(F.col("pos") / FAN), k), "level")
        nodes.append(up.withColumn("width", F.ceil(F.col("width") / FAN)))
        level = nodes[-1].select("start", "width", "pos", "first", "last", "digest")
        tops.append(level.where("width = 1"))

    subroots = reduce(DataFrame.unionByName, tops).select(F.col("start").alias("_start"), "first", "last", "digest")
    subroots = stage(numbered(stage(subroots, "subroots"), ["first"], "pos").drop("_p"), "subroots")
    count, top_nodes, k = subroots.count(), [], TOP
    level = subroots
    while count > 1:
        k, count = k + 1, -(-count // FAN)
        level = stage(parents(level, [], F.floor(F.col("pos") / FAN), k), "level")
        top_nodes.append((level, count))

    # links: a node's place in its parent; a subroot's parent is in the tree of subroots
    lone = not top_nodes
    links = subroots.select("_start", *([F.lit(None).cast("long").alias("_up"), F.lit(0).alias("_place")] if lone else [
        node_number(F.lit(TOP + 1), F.lit(0)).alias("_up"), (F.col("pos") % FAN).cast("int").alias("_place")]),
        F.floor(F.col("pos") / FAN).alias("_group"))
    if not lone:
        firsts = top_nodes[0][0].select(F.col("pos").alias("_group"), F.col("first").alias("_first"))
        links = links.join(firsts, "_group").withColumn("_up", F.col("_up") + F.col("_first"))
    links = stage(links.select("_start", "_up", "_place"), "links")

    def linked(rows: DataFrame, level: int) -> DataFrame:
        """Rows of a source's tree with ``parent`` and ``place``; only subroots, one a source, meet ``links``."""
        inner = rows.where("width > 1").withColumn(
            "parent", node_number(F.lit(level + 1), F.col("start") + F.floor(F.col("pos") / FAN) * F.lit(FAN ** (level + 1)).cast("long")))
        inner = inner.withColumn("place", (F.col("pos") % FAN).cast("int"))
        tops = rows.where("width = 1").join(links, F.col("start") == F.col("_start"))
        tops = tops.withColumn("parent", F.col("_up")).withColumn("place", F.col("_place"))
        return inner.unionByName(tops.select(inner.columns))

    runs = linked(runs.withColumn("width", width).withColumn("pos", ((F.col("first") - F.col("start")) / FAN).cast("long")), 1)
    columns = ["node", "level", "first", "last", "parent", "place", "children", "digest"]
    stored = [linked(rows, 2 + i).withColumn("node", node_number(F.col("level"), F.col("first"))).select(columns) for i, rows in enumerate(nodes)]
    for i, (rows, _) in enumerate(top_nodes):
        rows = rows.withColumn("node", node_number(F.col("level"), F.col("first")))
        if i + 1 < len(top_nodes):
            above = top_nodes[i + 1][0].select(F.col("pos").alias("_group"), F.col("first").alias("_first"))
            rows = rows.withColumn("_group", F.floor(F.col("pos") / FAN)).join(above, "_group")
            rows = rows.withColumn("parent", node_number(F.lit(TOP + 2 + i), F.col("_first")))
        else:
            rows = rows.withColumn("parent", F.lit(None).cast("long"))
        stored.append(rows.withColumn("place", (F.col("pos") % FAN).cast("int")).select(columns))
    spark = leaves.sparkSession
    empty = spark.createDataFrame([], "node long, level int, first long, last long, parent long, place int, children binary, digest binary")
    nodes = stage(reduce(DataFrame.unionByName, stored, empty), "nodes")
    root = (top_nodes[-1][0] if top_nodes else subroots).select("digest")
    return Manifest(stage(runs.select("first", "n", "leaves", "digest", "parent", "place"), "runs"), nodes, root)


CLIMB = f"""
WITH RECURSIVE climb (first, slice, step, folded, siblings, digest, subroot, parent, place) MAX RECURSION LEVEL 100 AS (
  SELECT first, slice, 0 AS step, folded, siblings, digest, subroot, parent, place FROM {{runs}}
  UNION ALL
  SELECT c.first, c.slice, c.step + 1,
    transform(c.folded, f -> unhex(sha2(lower(hex(concat(substring(p.children, 1, {DIGEST} * c.place), f, substring(p.children, {DIGEST} * (c.place + 1) + 1)))), 256))),
    concat(substring(p.children, 1, {DIGEST} * c.place), substring(p.children, {DIGEST} * (c.place + 1) + 1)),
    p.digest, CASE WHEN p.level < {TOP} THEN p.digest ELSE c.subroot END, p.parent, p.place
  FROM climb c JOIN {{nodes}} p ON c.parent = p.node AND c.slice = p.slice
)
SELECT first, step, siblings, CASE WHEN parent IS NULL THEN struct(folded, subroot, digest AS root) END AS top FROM climb
"""


def climb(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, folded), one row a leaf, digests as bytes.

    ``siblings`` holds the digests met from leaf to root; ``folded`` is the root that the leaf's changed digest gives. A step
    of the recursion appends a row with that step's siblings alone, and equal digests of a run climb once.
    """
    spark = manifest.runs.sparkSession
    leaves = F.col("leaves")

    # the first step, from each leaf of a run to the run's node
    def fold(x: Column, i: Column) -> Column:
        own = F.coalesce(x.changed, x.leaf)
        run = F.aggregate(F.transform(leaves, lambda y, j: F.when(j == i, own).otherwise(y.leaf)), F.lit(b""), lambda a, b: F.concat(a, b))
        return F.when(F.col("n") == 1, own).otherwise(h(run))

    slim = F.transform(leaves, lambda x: F.struct(x.doc_id.alias("doc_id"), x.leaf.alias("leaf")))
    runs = stage(manifest.runs.select("first", slim.alias("leaves"), F.transform(leaves, fold).alias("starts"), "digest", "parent", "place"), "starts")
    low = runs.select(
        "first", F.floor(F.col("first") / SLICE).alias("slice"), F.array_distinct("starts").alias("folded"), F.lit(b"").alias("siblings"),
        "digest", F.col("digest").alias("subroot"), "parent", "place")
    copies = F.explode(F.sequence(F.floor(F.col("first") / SLICE), F.floor((F.col("last") - 1) / SLICE))).alias("slice")
    nodes = manifest.nodes.select("node", "level", "parent", "place", "children", "digest", copies)
    limit = "spark.sql.cteRecursionRowLimit"  # rows grow with the table, levels do not
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        steps = stage(spark.sql(CLIMB, runs=low, nodes=nodes), "climbed")
    finally:
        spark.conf.set(limit, before)
    met = steps.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("met"), F.max("top").alias("top"))
    above = F.aggregate("met", F.lit(b""), lambda a, s: F.concat(a, s.siblings))
    done = runs.join(met.select("first", above.alias("above"), "top.*"), "first")
    distinct = done.withColumn("ways", F.array_distinct("starts"))
    rows = distinct.select("*", F.posexplode(F.arrays_zip("leaves", "starts")).alias("_i", "x"))
    others = F.aggregate(F.filter("leaves", lambda y, j: j != F.col("_i")), F.lit(b""), lambda a, y: F.concat(a, y.leaf))
    return rows.select(
        F.col("x.leaves.doc_id").alias("doc_id"), F.col("x.leaves.leaf").alias("leaf"), "subroot", "root",
        F.concat(others, F.col("above")).alias("siblings"),
        F.element_at("folded", F.array_position("ways", F.col("x.starts")).cast("int")).alias("folded"))


def leaves_of(docs: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """(doc_id, source, leaf, changed): digests of the rows, and where ``tampered`` the digest with ``change`` as the text."""
    columns = {"doc_id": F.col("doc_id").cast("long"), **{c: F.col(c) for c in COLUMNS[1:]}}
    changed = F.when(tampered, leaf_digest({**columns, "text": change}))
    return docs.select(columns["doc_id"].alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest(columns).alias("leaf"), changed.alias("changed"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; a fifth of the ids is tampered with."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(5)) == 0
    leaves = stage(leaves_of(docs, tampered, F.translate("text", UPPER, LOWER)), "leaves")
    rows = climb(build(leaves))
    return rows.select(
        "doc_id", *[hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(hex_text(F.col("siblings")), 256).alias("proof_sha256"), hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of ``text`` in UTF-8."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::BIGINT)"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: {bits}), 4294967295)"


def sql() -> str:
    def leaf(text: str) -> str:
        values = {c: f"CAST({c} AS VARCHAR)" for c in COLUMNS} | {"text": text}
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values.values()) + ")"

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS width FROM d),
own (source, level, pos, width, digest) AS (
  SELECT source, 0, pos, width, leaf FROM l
  UNION ALL
  SELECT source, level + 1, pos // {FAN}, (width + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)) FROM own WHERE width > 1 GROUP BY source, level, pos // {FAN}, width),
s AS (SELECT source, level AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS width FROM own WHERE width = 1),
top (level, pos, width, digest) AS (
  SELECT 0, pos, width, digest FROM s
  UNION ALL
  SELECT level + 1, pos // {FAN}, (width + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE width > 1 GROUP BY level, pos // {FAN}, width),
nodes AS (
  SELECT source, level, pos, width, digest FROM own WHERE width > 1
  UNION ALL SELECT NULL, 1000 + level, pos, width, digest FROM top),
runs AS (SELECT source, level, pos // {FAN} AS grp, any_value(width) AS width, list(digest ORDER BY pos) AS digests FROM nodes GROUP BY source, level, pos // {FAN}),
climb (doc_id, leaf, subroot, source, level, pos, proof, folded) AS (
  SELECT l.doc_id, l.leaf, s.digest, CASE WHEN l.width > 1 THEN l.source END, CASE WHEN l.width > 1 THEN 0 ELSE 1000 END,
    CASE WHEN l.width > 1 THEN l.pos ELSE s.pos END, '', coalesce(l.changed, l.leaf)
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, leaf, subroot, CASE WHEN done THEN NULL ELSE source END, CASE WHEN done THEN 1000 ELSE level + 1 END, CASE WHEN done THEN top_pos ELSE pos // {FAN} END,
    proof || before || after, sha256(before || folded || after)
  FROM (
    SELECT c.*, c.level < 1000 AND c.level + 1 = s.height AS done, s.pos AS top_pos,
      array_to_string(r.digests[1:c.pos % {FAN}], '') AS before, array_to_string(r.digests[c.pos % {FAN} + 2:], '') AS after
    FROM climb c JOIN runs r ON c.source IS NOT DISTINCT FROM r.source AND c.level = r.level AND c.pos // {FAN} = r.grp AND r.width > 1
    LEFT JOIN s ON c.level < 1000 AND s.source IS NOT DISTINCT FROM c.source))
SELECT c.doc_id, c.leaf, c.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.digest AS verified
FROM climb c, (SELECT level, digest FROM top WHERE width = 1) t WHERE c.level = 1000 + t.level
"""
