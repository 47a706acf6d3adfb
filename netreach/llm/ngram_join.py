"""N-gram Jaccard join: every document's class under "shingle sets with Jaccard similarity of at least ``percent`` link".

1. Each text becomes a set of hashed shingles; equal word sequences share an id, so exact copies enter once.
2. The root of the signature tree is keyed. All shingles are ordered: those below a hash bound, rarest first; then the
   other ones by hash; then those that a bounded sample of texts shows to be very frequent. Two linked sets share one of
   the first n - ceil(percent x n / 100) + 1 shingles of each, whatever the order is. Document counts are exact for the
   shingles below the bound. Sets that share a leading shingle are chained, and the chains' components are groups that
   no link leaves. The sample only moves frequent shingles to the end; it decides no link.
3. A group's sets are read once more from the texts and joined by dual traversal of a signature tree
   (``signature_tree``). A group with more sets than one task should hold is cut into blocks: within blocks first, then
   one set of each class found, then the sets outside the group's largest class against all blocks. A group of very many
   sets that share leading shingles but are not alike costs the square of its blocks.
4. Links that join classes become components; a class is named by its smallest ``doc_id``.

Null or blank texts have no shingles and are linked with nothing: their class is their own ``doc_id``. Fewer words than
the width make one shingle. A null ``doc_id`` is never a class's name unless all are null. Repeated rows give rows each.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netreach.llm.common import join_hot, small, stage
from netreach.llm.components import components
from netreach.llm.shingles import shingle_set
from netreach.llm.signature_tree import SignatureTree, links

#: Texts in the sample of very frequent shingles, about, and the count in it from which a shingle is one.
SAMPLE, FREQUENT = 10_000, 10
#: The share of the hash range whose shingles are counted.
COUNTED = 0.3
#: Shingles gathered before a task hands them on.
FLUSH = 1_000_000
#: Most sets and shingles of a group, or of a block, in one task.
BLOCK_SETS, BLOCK_TOKENS = 2_000, 3_000_000
SALTS = 64
#: Rows taken from an Arrow batch at a time.
SLICE = 256

_TOP = np.uint64(1 << 63)


def signed(x: np.ndarray) -> np.ndarray:
    return (x ^ _TOP).view(np.int64)


def texts(batches, *columns):
    """Rows of Arrow batches as tuples, few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def lead(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least FREQUENT texts of a sample by id hash, and their counts: at most SAMPLE x length / FREQUENT."""
    step = max(1, docs.count() // SAMPLE)

    def count(batches):
        for (text,) in texts(batches, "text"):
            yield pa.RecordBatch.from_pydict({"token": signed(shingle_set(text, width)[1])})

    found = (
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text").mapInArrow(count, "token long")
        .groupBy("token").count().where(F.col("count") >= FREQUENT).toPandas()
    )
    token = found["token"].to_numpy(np.int64).view(np.uint64) ^ _TOP
    order = np.argsort(token)
    return token[order], found["count"].to_numpy(np.int64)[order]


def scan(docs: DataFrame, width: int, percent: int, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Rows of documents (doc_id, sid, n, tail: leading shingles that are frequent) and of shingles packed by bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    bound = np.uint64(int(COUNTED * 2.0**64))

    def run(batches):
        hot_token, hot_count = shared.value
        seen, tokens, owners, needs, held = set(), [], [], [], 0
        rows = []

        def flush():
            if held:  # all texts may consist of frequent shingles alone
                t, o, q = np.concatenate(tokens), np.concatenate(owners), np.concatenate(needs)
                b = (t % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                t, o, q, b = signed(t)[order], o[order], q[order], b[order]
                cut = np.flatnonzero(np.diff(b, prepend=-1))
                ends = np.append(cut[1:], len(b))
                pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())
                size = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.list_(pa.int64())),
                     pa.array(b[cut], pa.int64()), pack(t), pack(o), pack(q)], names=NAMES)

        def documents():
            d, s, n, tail = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(tail, pa.list_(pa.int64())),
                 pa.nulls(len(rows), pa.int64()), none, none, none], names=NAMES)

        for doc_id, text in texts(batches, "doc_id", "text"):
            sid, s = shingle_set(text, width)
            n, tail = len(s), None
            if n and sid not in seen:
                seen.add(sid)
                p = lead(n, percent)
                at = np.searchsorted(hot_token, s)
                at[at == len(hot_token)] = 0
                is_hot = hot_token[at] == s if len(hot_token) else np.zeros(n, bool)
                cool = s[~is_hot]
                counted = int(np.searchsorted(cool, bound))
                send = cool[:max(p, counted)]
                if len(send) < p:
                    warm, c = s[is_hot], hot_count[at[is_hot]]
                    tail = signed(warm[np.lexsort((warm, c))][:p - len(send)]).tolist()
                tokens.append(send)
                owners.append(np.full(len(send), sid, np.int64))
                # how many of the counted ones may be left out; if they do not fill the lead, none
                needs.append(np.full(len(send), counted - p if counted >= p else -1, np.int64))
                held += len(send)
            rows.append((doc_id, sid, n, tail))
            if len(rows) >= 5_000:
                yield from documents()
                rows.clear()
            if held >= FLUSH:
                yield from flush()
                tokens.clear(), owners.clear(), needs.clear()
                held = 0
        if rows:
            yield from documents()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, sid long, n int, tail array<long>, bucket long, tokens binary, owners binary, needs binary")


NAMES = ["doc_id", "sid", "n", "tail", "bucket", "tokens", "owners", "needs"]


def shared_shingles(packed: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: (sid, token, df, spare) for each shingle that at least two sets have."""
    t, o, q = (np.frombuffer(b"".join(packed[c]), np.int64) for c in ("tokens", "owners", "needs"))
    order = np.lexsort((o, t))
    t, o, q = t[order], o[order], q[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    t, o, q = t[new], o[new], q[new]
    start = np.flatnonzero(np.diff(t, prepend=~t[:1]))
    df = np.diff(np.append(start, len(t)))
    df = np.repeat(df, df)
    keep = df > 1
    return pd.DataFrame({"sid": o[keep], "token": t[keep], "df": df[keep], "spare": q[keep]})


def groups(rows: DataFrame) -> DataFrame:
    """(sid, group) of every set that shares a leading shingle with another."""
    packed = rows.where("bucket IS NOT NULL").select("bucket", "tokens", "owners", "needs")
    shared = packed.groupBy("bucket").applyInPandas(shared_shingles, "sid long, token long, df long, spare long")
    bound = int(COUNTED * 2.0**64) - (1 << 63)
    # a set's counted shingles, rarest first: those that no other set has lead, then the shared ones
    own = Window.partitionBy("sid")
    counted = F.col("token") < bound
    shared = shared.withColumns({
        "place": F.row_number().over(own.orderBy(~counted, F.desc("df"), F.desc("token"))),
    })
    leading = shared.where((F.col("spare") < 0) | (counted & (F.col("place") > F.col("spare")))).select("token", "sid", F.lit(0).alias("salt"))
    tail = rows.where("tail IS NOT NULL").select(F.explode("tail").alias("token"), "sid").distinct()
    keyed = stage(leading.unionByName(tail.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int"))), "leading")
    first = stage(keyed.groupBy("token", "salt").agg(F.min("sid").alias("a"), F.count("*").alias("n")), "first")
    within = keyed.join(first.where("n > 1"), ["token", "salt"]).select("a", F.col("sid").alias("b"))
    top = first.groupBy("token").agg(F.min("a").alias("b"), F.count("*").alias("k")).where("k > 1")
    across = first.join(top, "token").select("a", "b")
    return components(within.unionByName(across).where("a <> b").distinct()).select(F.col("node").alias("sid"), F.col("label").alias("group"))


def packed_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets of ``wanted`` (key, sid, group, block), read again from the texts."""
    def run(batches):
        for key, sid, group, block, text in texts(batches, "key", "sid", "group", "block", "text"):
            found, s = shingle_set(text, width)
            if found == sid:
                yield pa.RecordBatch.from_pydict({"sid": pa.array([sid]), "group": pa.array([group]), "block": pa.array([block], pa.int32()), "tokens": pa.array([s.tobytes()], pa.binary())})

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("key"), "text")
    return keyed.join(small(wanted), "key").select("key", "sid", "group", "block", "text").mapInArrow(run, "sid long, group long, block int, tokens binary")


def _sets(part: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    part = part.drop_duplicates("sid")
    return part["sid"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in part["tokens"]]


def _join_one(part: pd.DataFrame, percent: int):
    """(sid, smallest sid of its class) of the linked sets of one group or block."""
    sids, sets = _sets(part)
    if len(sids) < 2:
        return
    tree = SignatureTree(sets)
    ids = sids[tree.order]
    labels = np.arange(len(ids))
    for _ in links(tree, tree, labels, labels, percent):
        pass
    first = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(first, labels, ids)
    alone = np.bincount(labels, minlength=len(ids)) == 1
    for k in np.flatnonzero(~alone[labels]):
        yield int(ids[k]), int(first[labels[k]])


def inner_links(sets: DataFrame, percent: int, by: list[str], buckets: int) -> DataFrame:
    """Links (a set and its class's smallest) within each group of the columns ``by``; small groups share a task's frame."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, one in part.groupby(by, sort=False) for x in _join_one(one, percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return sets.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets))).groupBy("_bucket").applyInPandas(run, "a long, b long")


def outer_links(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """For groups in several blocks: links of sets outside the group's largest class with sets of other classes."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        one, two = part[part["side"] == 0], part[part["side"] == 1]
        if len(one) and len(two):
            (ids_one, sets_one), (ids_two, sets_two) = _sets(one), _sets(two)
            label = dict(zip(part["sid"], part["label"], strict=True))
            names = {x: k for k, x in enumerate(sorted(set(label.values())))}
            tree_one, tree_two = SignatureTree(sets_one), SignatureTree(sets_two)
            ids_one, ids_two = ids_one[tree_one.order], ids_two[tree_two.order]
            marks = [np.array([names[label[x]] for x in ids]) for ids in (ids_one, ids_two)]
            found = [(int(ids_one[i]), int(ids_two[j])) for i, j in links(tree_one, tree_two, *marks, percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    labelled = sets.join(classes, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    sizes = labelled.groupBy("group", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("group").agg(F.max(F.struct("n", "label")).alias("top")).select("group", F.col("top.label").alias("top"))
    labelled = stage(labelled.join(F.broadcast(largest) if largest.count() <= 10_000 else largest, "group"), "labelled")
    rest = labelled.where("label <> top")
    lefts = rest.select("group", F.col("block").alias("left")).distinct()
    rights = labelled.select("group", F.col("block").alias("right")).distinct()
    side_one = rest.withColumnRenamed("block", "left").join(rights, "group").withColumn("side", F.lit(0))
    side_two = labelled.withColumnRenamed("block", "right").join(lefts, "group").withColumn("side", F.lit(1))
    return side_one.unionByName(side_two).groupBy("group", "left", "right").applyInPandas(run, "a long, b long")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id, sequence_id) for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = stage(scan(docs, width, percent, frequent_shingles(docs, width), 4 * parts), "shingles")
    documents = rows.where("sid IS NOT NULL").select("doc_id", "sid", "n")
    group = stage(groups(rows), "groups")
    first = documents.groupBy("sid").agg(F.min(F.coalesce("doc_id", F.lit(-1 << 63))).alias("key"), F.min("doc_id").alias("id"), F.first("n").alias("n"))
    member = stage(group.join(first, "sid"), "members")
    size = member.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("sets") / block_sets, F.col("shingles") / block_tokens)).cast("int")
    sized = join_hot(member, size.select("group", blocks.alias("blocks")), "group", "sid")
    wanted = stage(sized.select("key", "sid", "group", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), "blocks"), "wanted")
    sets = packed_sets(docs, wanted.drop("blocks"), width)
    split = wanted.where("blocks > 1").limit(1).count() > 0
    if split:
        sets = stage(sets, "sets")
    found = stage(inner_links(sets, percent, ["group", "block"], 4 * parts), "links")
    classes = found.select(F.col("a").alias("node"), F.col("b").alias("label"))  # whole, where groups are not cut
    if split:
        cut = wanted.where("blocks > 1").select("group").distinct()
        large = stage(sets.join(cut, "group", "left_semi"), "large")
        one_each = large.join(classes.withColumnRenamed("node", "sid"), "sid", "left").where("label IS NULL OR label = sid").drop("label")  # one set of each class of a block
        crowd = one_each.groupBy("group").agg(F.count("*").alias("k"))
        few = one_each.join(crowd.where(F.col("k") <= block_sets).select("group"), "group", "left_semi")
        found = stage(found.unionByName(inner_links(few, percent, ["group"], parts)), "links")
        found = found.unionByName(outer_links(large, stage(components(found).withColumnRenamed("node", "sid"), "classes"), percent))
        classes = components(found)
    labels = classes.select(F.col("node").alias("sid"), "label")
    named = first.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    name = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = join_hot(named.select("sid", "label"), name, "label", "sid").select("sid", "component_id")
    linked = join_hot(documents.where("n > 0"), named, "sid", "doc_id")
    alone = documents.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone, allowMissingColumns=True).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("sid").alias("sequence_id"))
