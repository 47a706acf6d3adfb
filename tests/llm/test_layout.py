"""Mixing, sharding and training order, against brute force; the pipeline's stages on the smallest tables."""
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from conftest import words
from pyspark.sql import functions as F

import corpus_pipeline
from netreach.llm import mixing, sharding, training_order

DATA = "/root/testdata/sf0.001"


def fill(budget, rooms, weights):
    """Shares by weight, what is full left out, again until all fits."""
    given, open_ = dict.fromkeys(rooms, 0.0), {k for k in rooms if weights[k] > 0 and rooms[k] > 0}
    while open_ and budget > 1e-9:
        level = budget / sum(weights[k] for k in open_)
        full = {k for k in open_ if rooms[k] <= level * weights[k] + 1e-9}
        for k in full or open_:
            given[k] = rooms[k] if full else level * weights[k]
        budget -= sum(given[k] for k in full or open_)
        open_ -= full or open_
    return given


def test_budgets(spark):
    rng = random.Random(1)
    leaves = [(f"d{d}", lang, f"s{s}", rng.randrange(0, 500)) for d in range(3) for lang in ("en", "fr") for s in range(4)]
    weights = {("d0",): 5.0, ("d1",): 0.0, ("d0", "en"): 4.0, ("d2", "fr", "s1"): 9.0}
    w = lambda *key: weights.get(key, 1.0)
    for share in (0.1, 0.5, 0.9, 1.5):
        supply = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
        total = float(int(sum(x[3] for x in leaves) * share))
        got = {(r.domain, r.lang, r.source): r.target for r in mixing.budgets(supply, weights, mixing.F.lit(total), 2).collect()}
        room = {x[:3]: 2.0 * x[3] for x in leaves}
        of = lambda *head: sum(v for k, v in room.items() if k[:len(head)] == head)
        domains = fill(total, {d: of(d) for d in ("d0", "d1", "d2")}, {d: w(d) for d in ("d0", "d1", "d2")})
        for d, b in domains.items():
            for lang, c in fill(b, {x: of(d, x) for x in ("en", "fr")}, {x: w(d, x) for x in ("en", "fr")}).items():
                own = {f"s{s}": room[d, lang, f"s{s}"] for s in range(4)}
                for s, t in fill(c, own, {x: w(d, lang, x) for x in own}).items():
                    assert got[d, lang, s] == pytest.approx(t, abs=1e-6)


def test_mix_against_sql(spark, messy, nothing):
    for table in (spark.read.parquet(f"{DATA}/documents.parquet"), messy, nothing):
        con = duckdb.connect()
        con.register("documents", table.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}).convert_dtypes())
        if not table.count():
            assert mixing.mix(table).count() == 0
            continue
        want = con.execute(mixing.sql()).fetchall()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, want)) == sorted(map(key, mixing.mix(table).collect()))
    kept = mixing.mix_documents(messy, fraction=0.5)
    assert kept.columns == messy.columns and kept.count() <= messy.count()


@pytest.mark.parametrize("cells", [8, 1 << 15])
def test_minimax_shards(docs_of, messy, nothing, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    monkeypatch.setattr(sharding, "ROWS_IN_A_RUN", 5)
    rng = random.Random(cells)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(300)]
    texts += rng.choices(texts, k=60) + [None, ""]
    rows = sharding.minimax_shards(docs_of(texts), 7).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    order = sorted(rows, key=lambda r: r.group_key)
    sizes = {}
    for r in order:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        sizes[r.group_key] = sizes.get(r.group_key, 0) + r.size
    assert len({(r.group_key, r.shard) for r in rows}) == len(sizes)
    assert [r.shard for r in order] == sorted(r.shard for r in order)

    def fits(capacity):
        used, at = 1, 0
        for s in sizes.values():
            if s > capacity:
                return False
            used, at = (used, at + s) if at + s <= capacity else (used + 1, s)
        return used <= 7

    capacity = next(c for c in range(sum(sizes.values()) // 7, sum(sizes.values())) if fits(c))
    loads = [sum(r.size for r in rows if r.shard == k) for k in range(7)]
    assert max(loads) == capacity
    for k in range(7):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    # a group beyond an even share has a shard of its own, and the others stay even
    heavy = sharding.minimax_shards(docs_of(["hot text " * 20] * 200 + texts), 7).collect()
    hot = {r.shard for r in heavy if r.doc_id < 200}
    assert hot == {6} and all(r.shard != 6 for r in heavy if r.doc_id >= 200)
    assert sharding.minimax_shards(messy, 40).count() == messy.count()
    assert sharding.minimax_shards(nothing, 40).count() == 0


def test_permutation():
    for count in (1, 2, 3, 17, 1000, 4096, 5000):
        got = training_order.permute(np.arange(count), count, 3)
        assert sorted(got.tolist()) == list(range(count))
    assert not np.array_equal(training_order.permute(np.arange(1000), 1000, 3), training_order.permute(np.arange(1000), 1000, 4))


def test_training_order_round_trip(spark, messy, nothing, tmp_path):
    order = training_order.training_order(messy, length=64, rows=16).cache()
    rows = order.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 128 and len(r.tokens) == 128 for r in rows)
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(training_order.VOCABULARY, "rb") if x.strip())}
    encoding = tiktoken.Encoding("v", pat_str=training_order.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.part, np.frombuffer(r.tokens, "<u2")[:r.n_tokens]))
    long_text = next(r.text for r in messy.collect() if r.doc_id == 4)
    ids = np.concatenate([x for _, x in sorted(parts[4], key=lambda x: x[0])])
    assert ids[-1] == training_order.END and encoding.decode(ids[:-1].tolist()) == long_text
    assert len(parts[1]) == 1 and parts[1][0][1].tolist() == [training_order.END] and len(parts[7]) == 2
    again = training_order.training_order(messy.repartition(7), length=64, rows=16)
    assert sorted((r.slot, bytes(r.tokens)) for r in again.collect()) == sorted((r.slot, bytes(r.tokens)) for r in rows)
    path = str(tmp_path / "shards")
    training_order.write_shards(order.where("shard < 2"), path)
    training_order.write_shards(order, path)
    got = training_order.read_slots(spark, path, 10, 40, length=64, rows=16).collect()
    by_slot = {r.slot: bytes(r.tokens) for r in rows}
    assert [(r.slot, bytes(r.tokens)) for r in got] == [(s, by_slot[s]) for s in range(10, 40)]
    assert spark.read.parquet(path).count() == len({r.shard for r in rows})
    # a run that stopped before its end leaves whole shards, which are not written again
    (tmp_path / "shards" / "_SUCCESS").unlink()
    training_order.write_shards(order, path)
    assert spark.read.parquet(path).count() == len({r.shard for r in rows})
    assert all(len(r.data) == 128 * 16 for r in spark.read.parquet(path).where(f"shard < {max(r.shard for r in rows)}").collect())
    # partitions are ranges of whole shards, in order of slot
    parts = order.select("slot", "shard", F.spark_partition_id().alias("part")).collect()
    of = {}
    for r in parts:
        assert of.setdefault(r.shard, r.part) == r.part
    assert [of[s] for s in sorted(of)] == sorted(of.values())
    (tmp_path / "empty").mkdir()
    training_order.write_shards(order.where("shard = 0"), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 1
    assert training_order.training_order(nothing).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    left = docs
    for name, step in corpus_pipeline.STAGES:
        before, left = left, step(spark, left, DATA)
        if name != "sharding":
            assert left.columns == docs.columns
            ids = {r.doc_id for r in left.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) >= 0.6 * before.count()
            left = spark.createDataFrame(left.collect(), docs.schema)
        else:
            assert left.count() == before.count()
    assert os.path.exists(corpus_pipeline.__file__)


def test_pipeline_stages_on_messy_rows(spark, messy, nothing):
    for docs in (messy, nothing):
        left = docs
        for name, step in corpus_pipeline.STAGES:
            left = step(spark, left, DATA)
            assert name == "sharding" or left.columns == docs.columns
        assert left.count() <= docs.count()
