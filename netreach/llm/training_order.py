"""Training order: every token sequence gets a global slot by a keyed permutation, and shards hold slots at a fixed stride.

1. Texts are dealt by hash cells of their id and text (``CELLS``, more for more rows), and within a cell ordered by id and text hash. Each is tokenized,
   ended by the end token, and cut into sequences of ``length`` tokens, the last one padded with the end token. A
   sequence is numbered within its cell, so its number does not depend on the cluster.
2. The cells' counts give every sequence its number in the corpus.
3. A Feistel network keyed by ``seed`` permutes the numbers below the next power of four; numbers that land beyond the
   count are permuted again (cycle-walking), which keeps it a permutation of the count. The result is the slot.
4. Slot s is row s mod ``rows`` of shard s div ``rows``; every row has 2 x ``length`` bytes (little-endian token ids).

So the training order can be read in sequence or taken up at any slot, and is the same for the same rows, ``seed`` and
``length``. Null and empty texts give one sequence of end tokens. Repeated rows give sequences each. Other columns are ignored; an empty table gives no rows. Tasks hold one text and a few sequences at a time.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netreach.llm.common import stage

#: Where a public vocabulary of byte-pair ranks lies, its end token, and how it parts texts (fixed value of the vocabulary).
VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cells at least, and rows of one cell, about, beyond that.
CELLS, CELL_ROWS = 1024, 10_000
ROUNDS = 6
#: Sequences handed on at a time, rows taken from an Arrow batch at a time.
BATCH, SLICE = 1024, 128

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def permute(number: np.ndarray, count: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 to ``count`` - 1, for each number given."""
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    round_keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in round_keys:
            f = right + key
            f = (f ^ (f >> np.uint64(30))) * _A
            f = (f ^ (f >> np.uint64(27))) * _B
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    out = once(number.astype(np.uint64))
    while (beyond := out >= np.uint64(count)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int, vocabulary: str, cells: int) -> DataFrame:
    """(cell, number, doc_id, part, n_tokens, tokens) of every sequence, numbered within its cell."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a vocabulary of a fixed size
    doc_id = F.col("doc_id").cast("long")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = docs.select(doc_id.alias("doc_id"), "text", F.pmod(F.xxhash64(doc_id, text_hash), F.lit(cells)).cast("int").alias("cell"), text_hash.alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "doc_id", "h").drop("h")

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in shared.value.splitlines() if line.strip())}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        rows: list[tuple] = []
        cell_now, number = None, 0

        def out():
            columns = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                for doc, text, cell in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if cell != cell_now:
                        cell_now, number = cell, 0
                    ids = np.array([*encoding.encode_ordinary(text or ""), END], "<u2")
                    for n, at in enumerate(range(0, len(ids), length)):
                        own = ids[at:at + length]
                        row = np.full(length, END, "<u2")
                        row[:len(own)] = own
                        rows.append((cell, number, doc, n, len(own), row.tobytes()))
                        number += 1
                        if len(rows) >= BATCH:
                            yield out()
                            rows.clear()
        if rows:
            yield out()

    return dealt.mapInArrow(run, "cell int, number long, doc_id long, part int, n_tokens int, tokens binary")


NAMES = ["cell", "number", "doc_id", "part", "n_tokens", "tokens"]


def training_order(docs: DataFrame, length: int = 512, rows: int = 256, seed: int = 13, vocabulary: str = VOCABULARY) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, part, n_tokens, tokens), partitions being ranges of whole shards in order of slot."""
    cells = max(CELLS, docs.count() // CELL_ROWS)
    found = stage(sequences(docs, length, vocabulary, cells), "sequences")
    counts = sorted((r.cell, r["count"]) for r in found.groupBy("cell").count().collect())  # a row a cell
    count = sum(n for _, n in counts)
    before = np.zeros(cells, np.int64)
    at = 0
    for cell, n in counts:
        before[cell] = at
        at += n

    shared = docs.sparkSession.sparkContext.broadcast(before)  # a number a cell

    @F.pandas_udf("long")
    def slot(cell: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(permute(shared.value[cell.to_numpy()] + number.to_numpy(), count, seed))

    placed = found.withColumn("slot", slot("cell", "number")).withColumn("shard", F.floor(F.col("slot") / rows).cast("long"))
    placed = placed.withColumn("byte_offset", (F.col("slot") % rows) * (2 * length))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        placed.select("slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "tokens")
        .repartitionByRange(parts, "shard").sortWithinPartitions("slot")
    )


SHARD = "shard long, data binary"


def write_shards(order: DataFrame, path: str) -> None:
    """Append to ``path`` the shards that it lacks: a row (shard, data) each, ``data`` being its rows at their stride.

    Tasks take ranges of shards and hold one shard at a time. A run that was stopped is taken up by calling it again:
    shards that are there already, whether or not the run that wrote them came to its end, are not written twice.
    """
    spark = order.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        order = order.join(spark.read.schema(SHARD).parquet(path).select("shard"), "shard", "left_anti")

    def join(batches):
        now, data = None, []
        for batch in batches:
            for shard, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now and data:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "data": pa.array([b"".join(data)], pa.binary())})
                    data = []
                now = shard
                data.append(tokens)
        if data:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "data": pa.array([b"".join(data)], pa.binary())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = order.select("shard", "slot", "tokens").repartitionByRange(parts, "shard").sortWithinPartitions("slot")
    ranges.select("shard", "tokens").mapInArrow(join, SHARD).write.mode("append").parquet(path)


def read_slots(spark: SparkSession, path: str, first: int, last: int, length: int = 512, rows: int = 256) -> DataFrame:
    """(slot, tokens) of the slots from ``first`` to before ``last``, in order; only their shards are read."""
    stride = 2 * length
    shards = spark.read.schema(SHARD).parquet(path).where(F.col("shard").between(first // rows, (last - 1) // rows))
    row = F.explode(F.sequence(F.lit(0), (F.length("data") / stride).cast("int") - 1))
    cut = shards.select("shard", "data", row.alias("row"))
    cut = cut.select((F.col("shard") * rows + F.col("row")).alias("slot"), F.substring("data", F.col("row") * stride + 1, F.lit(stride)).alias("tokens"))
    return cut.where((F.col("slot") >= first) & (F.col("slot") < last)).orderBy("slot")
