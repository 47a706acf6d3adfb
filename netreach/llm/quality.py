"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated output.

1. Tokens are runs of letters, of other signs, and marks for digits and for words in capitals. Each falls into one of
   ``VOCABULARY`` bins by hash and has a fixed sparse random index vector. A word's vector sums the index vectors of its
   left and right neighbours over all texts of the corpus.
2. A document's vector is the mean of its words' vectors (scaled to length 1), next to the mean of their index vectors
   and two figures of its length and of how few different tokens it has.
3. A network of one hidden layer is trained on a bounded sample of labelled texts; a part of them that it is not trained
   on sets the temperature at which its output is read as a probability.

Null and empty texts have the zero vector and are scored by the network too. Without labelled rows of both classes every
score is 0.5. Repeated rows give rows each; other columns are ignored; an empty table gives no rows. Memory in a task is
the table of bins and a few texts, in the driver that table and the sample's vectors.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netreach.llm.labelled import held_out, training_texts

#: Bins of words, numbers of a vector, and of those the ones that are not zero in an index vector.
VOCABULARY, SIZE, ONES = 1 << 13, 32, 4
#: Labelled texts of each class in the sample, at most.
TRAINING = 6_000
HIDDEN, ROUNDS, SEED = 24, 400, 11
#: The share of the sample that sets the temperature.
CALIBRATION = 0.2
#: Token bins remembered in a task, tokens handled at a time, rows taken from an Arrow batch at a time.
REMEMBERED, CHUNK, SLICE = 500_000, 200_000, 128

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and signs of the non-zero numbers of each bin's index vector, and the vectors themselves."""
    random = np.random.default_rng(SEED)
    places = np.argsort(random.random((VOCABULARY, SIZE)), axis=1)[:, :ONES]
    signs = random.choice([-1.0, 1.0], (VOCABULARY, ONES))
    whole = np.zeros((VOCABULARY, SIZE), np.float32)
    np.put_along_axis(whole, places, signs.astype(np.float32), 1)
    return places, signs, whole


class Bins:
    """From a text to the bins of its tokens."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __getitem__(self, token: str) -> int:
        bin_ = self.known.get(token)
        if bin_ is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            mark = "0" if token[0].isdigit() else "A" if len(token) > 1 and token.isupper() else token.lower()
            bin_ = self.known[token] = zlib.crc32(mark.encode("utf-8", "surrogatepass")) % VOCABULARY
        return bin_

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, TOKEN.findall(text or "")), np.int64)


def rows_of(batches, column: int):
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield part, part.column(column).to_pylist()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The bins' vectors, summed over all texts and scaled to length 1: one table of VOCABULARY x SIZE numbers a task."""
    def run(batches):
        places, signs, _ = index_vectors()
        bins, table = Bins(), np.zeros(VOCABULARY * SIZE)
        for _, rows in rows_of(batches, 0):
            for text in rows:
                own = bins.of(text)
                for k in range(0, len(own), CHUNK):
                    b = own[k:k + CHUNK + 1]
                    for at, near in ((b[:-1], b[1:]), (b[1:], b[:-1])):
                        key = (at[:, None] * SIZE + places[near]).ravel()
                        if len(key) * 4 > len(table):
                            table += np.bincount(key, signs[near].ravel(), len(table))
                        else:
                            np.add.at(table, key, signs[near].ravel())
        width = VOCABULARY * SIZE // 16
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(16), pa.int32()), "sums": pa.array([table[k * width:(k + 1) * width].astype(np.float32).tobytes() for k in range(16)], pa.binary())})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in part["sums"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"part": [part["part"].iloc[0]], "sums": [total.tobytes()]})

    sums = docs.select("text").mapInArrow(run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").collect()
    table = np.zeros((16, VOCABULARY * SIZE // 16))
    for r in sums:
        table[r.part] = np.frombuffer(r.sums, np.float64)
    table = table.reshape(VOCABULARY, SIZE)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def document_vectors(docs: DataFrame, table: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``x``, the document's vector."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # VOCABULARY x SIZE numbers

    def run(batches):
        _, _, index = index_vectors()
        both, bins = np.concatenate([shared.value, index], axis=1), Bins()
        for part, rows in rows_of(batches, len(keep)):
            out = np.zeros((len(rows), 2 * SIZE + 2))
            for k, text in enumerate(rows):
                own = bins.of(text)
                if len(own):
                    found, n = np.unique(own, return_counts=True)
                    out[k, :-2] = n @ both[found] / len(own)
                    out[k, -2:] = np.log1p(len(own)) / 10, len(found) / np.sqrt(len(own)) / 10
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(out.astype(np.float32)), pa.list_(pa.float32()))], names=[*keep, "x"])

    found = docs.select(*keep, "text")
    schema = found.drop("text").withColumn("x", F.array(F.lit(0.0).cast("float"))).schema
    return found.mapInArrow(run, schema)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        return np.hstack([np.tanh(z @ self.first), np.ones((len(x), 1))]) @ self.second

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss with weight decay, classes weighed as they come; then the best temperature."""
    random = np.random.default_rng(SEED)
    aside = random.random(len(x)) < CALIBRATION
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    mean, scale = x[~aside].mean(0), x[~aside].std(0) + 1e-6
    net = Network(mean, scale, random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1] + 1, HIDDEN)), random.normal(0, 0.1, HIDDEN + 1))
    z = np.hstack([(x[~aside] - mean) / scale, np.ones(((~aside).sum(), 1))])
    t = y[~aside]
    state = [np.zeros_like(w) for w in (net.first, net.first, net.second, net.second)]
    for step in range(1, ROUNDS + 1):
        h = np.tanh(z @ net.first)
        hb = np.hstack([h, np.ones((len(h), 1))])
        d = (1 / (1 + np.exp(-np.clip(hb @ net.second, -30, 30))) - t) / len(t)
        grads = (z.T @ (np.outer(d, net.second[:-1]) * (1 - h * h)) + 1e-4 * net.first, hb.T @ d + 1e-4 * net.second)
        for k, (w, g) in enumerate(zip((net.first, net.second), grads, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if aside.any():
        logit, t = net.logits(x[aside]), y[aside]
        heats = np.exp(np.linspace(-2, 2, 81))
        net.temperature = float(min(heats, key=lambda h: np.logaddexp(0, -np.where(t > 0, 1, -1) * logit / h).mean()))
    return net


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = word_vectors(slim)
    sample = document_vectors(training_texts(slim, labels, "quality", 4, 2, TRAINING), table, ["label"]).collect()  # at most 2 x TRAINING
    y = np.array([r.label for r in sample], float)
    if len(set(y)) < 2:
        scored = slim.select("doc_id", F.lit(0.5).alias("score"))
    else:
        net = train(np.array([r.x for r in sample]), y)

        def run(batches):
            for batch in batches:
                x = np.array(batch.column(1).to_pylist()).reshape(-1, 2 * SIZE + 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(x))], names=["doc_id", "score"])

        scored = document_vectors(slim, table, ["doc_id"]).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
