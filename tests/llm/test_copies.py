"""Exact deduplication, n-gram Jaccard classes and components, against brute force."""
import hashlib
import random
import re

import numpy as np
from conftest import words

from netreach.llm import components, dedup, ngram_join, signature_tree
from netreach.llm.shingles import shingle_set


def test_exact_dedup(messy, nothing):
    rows = [(r.doc_id, re.sub("[\x20\x09-\x0D]+", " ", r.text or "")) for r in messy.select("doc_id", "text").collect()]
    got = dedup.exact_dedup(messy).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.doc_id in same and r.group_size == len(same)
        assert r.keep_id == min((i for i in same if i is not None), default=None)
    assert sum(r.kept for r in got) == len({t for _, t in rows})
    assert dedup.exact_dedup(nothing).count() == 0


def test_index_is_appended_and_reopened(spark, docs_of, tmp_path):
    index = dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    index.ingest(dedup.with_digests(docs_of(["a", "b", "a"])))
    again = dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    again.ingest(dedup.with_digests(docs_of(["c", "a  ", "b"])))
    assert sorted(r.keep_id for r in again.rows().collect()) == [0, 0, 1, 1]  # "a ", with a space, is a text of its own
    plan = again.rows().join(index.rows().hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def corpus(rng):
    base = [words(rng, n) for n in (3, 12, 40, 60, 80, 200)]
    texts = ["", None, "one two", "ONE  two", "one two three"]
    for text in base:
        for _ in range(12):
            own = text.split()
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(["new", "other", "word"])
            texts.append(" ".join(own))
    passage = words(rng, 60)
    return texts + [f"{words(rng, rng.randrange(5, 60))} {passage} {words(rng, 20)}" for _ in range(25)]


def brute(texts, width, percent):
    sets = []
    for t in texts:
        own = [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
        sets.append({tuple(own[k:k + width]) for k in range(max(1, len(own) - width + 1))} if own else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {i: (len(s), x) for i, (s, x) in enumerate(zip(sets, label, strict=True))}


def test_jaccard_classes(docs_of, monkeypatch):
    texts = corpus(random.Random(1))
    for width, percent, block in ((4, 85, 2000), (5, 80, 3), (2, 60, 4)):
        got = ngram_join.jaccard_classes(docs_of(texts), width, percent, block_sets=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, width, percent)
    # shingles that the sample finds frequent go last: the same classes
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    got = ngram_join.jaccard_classes(docs_of(texts), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 4, 85)


def test_jaccard_of_messy_rows(messy, nothing):
    got = ngram_join.jaccard_classes(messy).collect()
    assert len(got) == messy.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    assert of[8][0].component_id == 7 and of[1][0].component_id == 1 and of[2][0].n_shingles == 0
    assert {r.component_id for r in of[9]} == {9}
    assert ngram_join.jaccard_classes(nothing).count() == 0


def test_word_hashes_follow_words_alone():
    a, b = shingle_set("The  quick\tbrown fox jumps", 4), shingle_set(" the quick brown\nFOX jumps ", 4)
    assert a[0] == b[0] and np.array_equal(a[1], b[1]) and len(a[1]) == 2


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1001 + k) for k in range(80)]
    rng = random.Random(2)
    edges = chain + star + [(2000, 2000)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(81)}, 2000: 2000}


def test_short_bitmaps_lose_no_link(monkeypatch):
    """A block of one very large set and many small ones holds bitmaps of bounded size, and finds the same links."""
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (20, 40, 300, 40_000)]
    sets = []
    for one in base:
        for _ in range(15):
            own = one.copy()
            change = rng.integers(0, len(own), len(own) // 20)
            own[change] = rng.integers(0, 1 << 63, len(change), dtype=np.uint64)
            sets.append(np.unique(own))

    def classes():
        tree = signature_tree.SignatureTree(sets)
        labels = np.arange(len(sets))
        for _ in signature_tree.links(tree, tree, labels, labels, 80):
            pass
        return tree.levels[0][0].nbytes, sorted(sorted(tree.order[i] for i in np.flatnonzero(labels == x)) for x in np.unique(labels))

    whole, want = classes()
    monkeypatch.setattr(signature_tree, "HELD", 50_000)
    held, got = classes()
    assert got == want == [list(range(k, k + 15)) for k in (0, 15, 30, 45)] and held <= 50_000 < whole
