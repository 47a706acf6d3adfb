"""Language identification, the manifest and spelling variants, against brute force and held-out accuracy."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netreach.llm import language_id, manifest, spelling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- language identification


def plain_triples(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(letters.split()) + " " if letters.split() else ""
    return collections.Counter(padded[k:k + 3] for k in range(len(padded) - 2))


def plain_profile(text):
    total = np.zeros(language_id.SIZE)
    for triple, n in plain_triples(text).items():
        a, b, c = (np.random.default_rng([language_id.SEED, ord(x)]).integers(0, 2, language_id.SIZE, np.int8).astype(int) * 2 - 1 for x in triple)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    return total


def profile_of(text):
    profiles = language_id.Profiles()
    profiles.add(0, text)
    return profiles.sums(np.zeros((1, language_id.SIZE)))[0]


@pytest.mark.parametrize("text", ["Ab, cd 12 ef!", "x", "  É--é 你好 😀", "", "123 !?", "a" * 50 + " b"])
def test_profile_is_the_plain_sum(text, monkeypatch):
    want = plain_profile(text)
    assert np.array_equal(profile_of(text), want)
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "TRIPLES", 2)
        assert np.array_equal(profile_of(text), want)


def test_letters_are_forgotten_and_drawn_again(monkeypatch):
    want = profile_of("the quick brown fox jumps")
    monkeypatch.setattr(language_id, "LETTERS", 4)
    monkeypatch.setattr(language_id, "TRIPLES", 1)
    assert np.array_equal(profile_of("the quick brown fox jumps"), want)


def speech(rng, lang, n):
    parts = {"aa": "ba la mo ri ta ne", "bb": "sch tze ung ich kra pfu", "cc": "eau oui ille gne que aux"}[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark, messy, nothing, monkeypatch):
    rng = random.Random(1)
    rows = [(i, speech(rng, lang, rng.randrange(3, 40)), lang) for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], k=300))]
    rows += [(1000, None, "aa"), (1001, " 12 !", "bb"), (1002, "Mo", "aa"), (None, speech(rng, "bb", 9), None), (1003, speech(rng, "cc", 9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language(docs).collect()
    assert len(got) == len(rows)
    by_id = {x.doc_id: x for x in got}
    for i, _, lang in rows[:300]:
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= by_id[i].score <= 1
    held = [by_id[i].lang_pred == lang for i, _, lang in rows[:300] if by_id[i].held_out]
    assert len(held) > 40 and sum(held) / len(held) > 0.97
    assert (by_id[1000].lang_pred, by_id[1001].lang_pred, by_id[1000].score) == ("und", "und", 0.0) and by_id[1002].lang_pred != "und"
    assert by_id[None].lang_pred == "bb" and not by_id[None].held_out and by_id[1003].lang_pred == "cc"
    # held-out labels teach nothing, and neither the cut into tasks nor blocks of languages change a result
    turned = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "aa").otherwise(F.col("lang")))
    want = sorted((str(x.doc_id), x.lang_pred, round(x.score, 6)) for x in got)
    assert want == sorted((str(x.doc_id), x.lang_pred, round(x.score, 6)) for x in language_id.language(turned.repartition(5)).collect())
    monkeypatch.setattr(language_id, "PROTOTYPES", 2)
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    assert want == sorted((str(x.doc_id), x.lang_pred, round(x.score, 6)) for x in language_id.language(docs).collect())
    odd = language_id.language(messy).collect()
    assert len(odd) == messy.count() and {x.lang_pred for x in odd if x.doc_id in (1, 2, 3, 6)} == {"und"}
    assert {x.lang_pred for x in odd} <= {"en", "de", "fr", "und"}
    assert language_id.language(nothing).count() == 0
    assert {(x.lang_pred, x.score) for x in language_id.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


# ---------------------------------------------------------------- the manifest


def plain_hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fan):
    def leaf(r, text):
        return plain_hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [plain_hash("".join(nodes[i:i + fan])) for i in range(0, len(nodes), fan)]
            out.append(nodes)
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            low = i // fan * fan
            yield nodes[low:i], nodes[i + 1:low + fan]
            i //= fan

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for s in order}
    trees = {s: levels([leaf(r, r.text) for r in own[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order]) if order else None
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(own[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            node = leaf(r, r.text.translate(str.maketrans(UPPER, LOWER)) if tampered else r.text)
            for before, after in steps:
                node = plain_hash("".join(before) + node + "".join(after))
            proof = plain_hash("".join("".join(before) + "".join(after) for before, after in steps))
            out.append((r.doc_id, trees[s][0][i], trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(tuple(map(str, x)) for x in out)


def sorted_rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("fan, slice_", [(16, 1 << 16), (2, 4), (3, 5)])
def test_manifest(spark, messy, monkeypatch, fan, slice_):
    monkeypatch.setattr(manifest, "FAN", fan)
    monkeypatch.setattr(manifest, "SLICE", slice_)
    rng = random.Random(fan)
    rows = []
    for k, n in enumerate([1, 2, fan, fan + 1, fan * fan, fan * fan + 1, 40]):
        rows += [(len(rows) + i, rng.choice(["Some Text", "lower", None, "", "ÄÖ Xx"]), "en", None if k == 6 else f"s{k}é", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.unionByName(messy.select(docs.columns))
    assert sorted_rows(manifest.manifest(table)) == plain_manifest(table.collect(), fan)


def test_manifest_of_one_source_and_of_nothing(spark, docs_of, nothing, messy):
    for table in (docs_of(["Aa"]), docs_of(["Aa"] * 30).withColumn("source", F.lit("one")), messy):
        assert sorted_rows(manifest.manifest(table)) == plain_manifest(table.collect(), 16)
    assert manifest.manifest(nothing).count() == 0


def test_manifest_finds_what_was_changed(docs_of):
    """A proof fails for a changed text and holds for the others, whatever the change is."""
    docs = docs_of([f"Text number {i}" for i in range(70)])
    leaves = manifest.leaves_of(docs, F.col("doc_id").isin(3, 40), F.concat("text", F.lit("!")))
    rows = manifest.climb(manifest.build(leaves)).select("doc_id", (F.col("folded") == F.col("root")).alias("ok")).collect()
    assert {x.doc_id for x in rows if not x.ok} == {3, 40} and len(rows) == 70


# ---------------------------------------------------------------- spelling variants


def plain_counts(rows, every):
    n = collections.Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = w.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return n


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(n, times=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(tuple(map(str, x)) for x in out)


@pytest.mark.parametrize("rows, letters", [(4096, 1 << 22), (5, 1 << 22), (4096, 40)])
def test_near_words(spark, rows, letters):
    rng = random.Random(3)
    words = {"".join(rng.choice("abéÿ÷c") for _ in range(rng.randrange(1, 6))) for _ in range(400)} | {"x" * 3_000, "x" * 2_999 + "y", "x" * 3_001, "a"}
    table = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words), 1)], "word string, n long")
    got = [(x.word, x.near) for x in spelling.near_words(table, rows, letters).collect()]
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
    n = {w: i for i, w in enumerate(sorted(words), 1)}
    assert {(x.word, x.n, x.near, x.near_n) for x in spelling.near_words(table).collect()} == {(a, n[a], b, n[b]) for a, b in want}


def test_variants_and_chains(spark):
    """Forms of forms, ties of n by name, and no form below five times n."""
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 700, "aabbbb": 3500, "zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25, "kkkkkk": 6, "kkkkkl": 29}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted_rows(spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == plain_variants(n)
    roots = {x[0]: x[2] for x in got}
    assert roots["aaaaaa"] == "aabbbb" and roots["zzzzzz"] == "zzzzzx" and roots["kkkkkk"] == "kkkkkk"


def test_spelling_variants(spark, messy, nothing, monkeypatch):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé") for _ in range(7)) for _ in range(30)]

    def typo(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1:], w[:k] + "e" + w[k:], w[:k] + "b" + w[k + 1:]])

    texts = [" ".join(rng.choice([w.upper() if rng.random() < 0.1 else w, w, w, typo(w)]) for w in rng.choices(base, k=300)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, texts[7]), (50, None), (51, "")], "doc_id long, text string")
    n = {w: c for w, c in plain_counts(docs.collect(), 199).items() if len(w) >= 6 and c >= 5}
    assert sorted_rows(spelling.spelling_variants(docs)) == plain_variants(n) and len(n) > 60
    counted = {x.word: x.n for x in spelling.word_counts(messy, every=3, least_length=2, least_count=1).collect()}
    assert counted == {w: c for w, c in plain_counts(messy.collect(), 3).items() if len(w) >= 2}
    assert spelling.spelling_variants(messy).count() >= 1 and spelling.spelling_variants(nothing).count() == 0


# ---------------------------------------------------------------- an id that is null


def test_null_id_does_not_take_a_class_name(spark):
    from netreach.llm import ngram_join

    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (5, text), (9, text + " eleven"), (None, "only this one has no id at all here"), (7, "quite another text of some words here")]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == sorted([(None, 5), (5, 5), (9, 5), (None, None), (7, 7)], key=str)
