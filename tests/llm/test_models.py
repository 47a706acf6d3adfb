"""Toxicity and quality: the automaton against plain edit distance, labels of held-out rows never used, accuracy there."""
import random
import zlib

from conftest import words

from netreach.llm import quality, toxicity
from netreach.llm.lexicon import Matcher, Term, edits_allowed


def distance(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        new = [k]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_matcher_is_edit_distance():
    rng = random.Random(1)
    terms = [Term(t, s, 1.0) for t, s in (("abcab", False), ("bacbacbac", False), ("abc", False), ("cabb", True), ("ccccc", False))]
    matcher = Matcher(terms)
    every = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(3000)})
    got = matcher.match(every)
    for w in every:
        near = [(0 if t.stem else distance(w, t.text)) for t in terms if (w.startswith(t.text) if t.stem else distance(w, t.text) <= edits_allowed(t))]
        assert (w in got) == bool(near)
        if near:
            assert got[w][1] == min(near)


def labelled(spark, docs_of, bad, good, n=400):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(n):
        label = i % 4 == 0
        texts.append(bad(rng) if label else good(rng))
        labels.append((i, int(not label), int(label)))
    return docs_of(texts), labels


def toxic_text(rng):
    own = words(rng, 40).split()
    for word in rng.sample(["blockhead", "nincompoop", "dimwitted", "scoundrel"], 2):
        own.insert(rng.randrange(len(own)), word)
    return " ".join(own)


def test_toxicity(spark, docs_of, messy, nothing, no_labels):
    docs, labels = labelled(spark, docs_of, toxic_text, lambda rng: words(rng, 40))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, table).collect()}
    out = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(out)
    assert all(got[i].predicted == labels[i][2] for i in out)
    other = spark.createDataFrame([(i, q, 1 - t if i in set(out) else t) for i, q, t in labels] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in toxicity.toxicity(docs, other).collect()}
    model = toxicity.train(docs, table)
    cases = docs_of(["you are a nincompop and a blokhead", 'the word "nincompoop" is old', "a plain and harmless text", None, ""])
    score = [r.score for r in toxicity.score(cases, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert score[0] > 0.5 and score[1] < score[0] and max(score[2:]) < 0.5 and score[3] == score[4]
    assert toxicity.toxicity(messy, table).count() == messy.count()
    assert {r.score for r in toxicity.toxicity(messy, no_labels).collect()} == {0.0}
    assert toxicity.drop_toxic(messy, table).columns == messy.columns
    assert toxicity.toxicity(nothing, table).count() == 0


def test_quality(spark, docs_of, messy, nothing, no_labels):
    docs, labels = labelled(spark, docs_of, lambda rng: " ".join(w + rng.choice(["%%%", "###", "&&"]) for w in words(rng, 30).split()), lambda rng: words(rng, 40) + ".")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, table).collect()}
    out = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(out)
    assert all(got[i].predicted == labels[i][1] for i in out)
    rows = quality.quality(messy, table).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality(messy, no_labels).collect()} == {0.5}
    assert quality.quality(nothing, table).count() == 0


def test_rare_terms_are_learned_and_copies_count_once(spark):
    rng = random.Random(9)
    terms = ["".join(rng.choice("bcdfghjklmnpqrstvwz") for _ in range(9)) for _ in range(100)]
    rows = [(f"{words(rng, 6)} {t} {words(rng, 6)}", 1) for t in terms for _ in range(16)]
    rows += [("a text that has copiedword in it", 1)] * 60 + [(words(rng, 12), 0) for _ in rows]
    texts = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, label int")
    matcher, _ = toxicity.learn_terms(texts)
    # each is in one toxic text of a hundred
    assert set(matcher.match(terms)) == set(terms) and not matcher.match(["copiedword"])


def test_every_term_and_beginning_forgives_edits(spark):
    rng = random.Random(10)
    terms = [Term("".join(rng.choice("bcdfghjklmnpqrstvwz") for _ in range(rng.randrange(5, 10))), k % 4 == 0, 1.0) for k in range(150)]
    texts = [t.text[:2] + "x" + t.text[3:] + ("ing" if t.stem else "") for t in terms]
    features = toxicity.scorer(Matcher(terms), frozenset())(texts)
    assert (features[:, 1] > 0).all() and not features[:, 0].any()
    matcher = Matcher(terms[:40])
    near = lambda w, t: min(distance(w[:n], t.text) for n in (range(len(w) + 1) if t.stem else [len(w)]))
    every = {t.text[:k] + rng.choice(["", "b", "xx"]) + t.text[k + rng.randrange(2):] + rng.choice(["", "", "q", "ing"]) for t in terms[:40] for k in range(len(t.text))}
    got = matcher.match(sorted(every))
    for w in every:
        edits = [near(w, t) for t in matcher.terms if near(w, t) <= edits_allowed(t)]
        assert (w in got) == bool(edits) and (not edits or got[w][1] == min(edits))


def test_words_stay_beside_a_beginning():
    good = [("grobian", True, 100, 0), ("grobians", False, 40, 0), ("grobiansky", False, 40, 0), ("solo", False, 30, 0)]
    terms = toxicity.choose_terms(good, 1000, 1000)
    assert {(t.text, t.stem) for t in terms} == {("grobian", True), ("grobians", False), ("grobiansky", False), ("solo", False)}
    # two edits of the word, both within the beginning
    assert Matcher(terms).match(["grxxiansky"])["grxxiansky"][1] == 2


def test_no_term_is_left_out_and_words_are_read_to_their_end():
    good = [("".join(random.Random(k).choice("bcdfghjklmnpqrstvwz") for _ in range(9)), False, 50, 0) for k in range(300)]
    assert len(toxicity.choose_terms(good, 1000, 1000)) == len({x[0] for x in good})
    far, long = "".join(chr(0x1D41A + k) for k in range(6)), "ab" * 30 + "c"
    matcher = Matcher([Term(far, False, 1.0), Term(long, False, 1.0), Term("ab" * 5, False, 1.0), Term("stemword", True, 1.0)])
    others = chr(0x1D41B) + far[1:]
    got = matcher.match([far, others, far + "x" * 9, long, long[:40], long + "ab" * 20, "ababababab" + "x" * 60, "stemword" + "y" * 500, chr(0x1F600) * 6])
    assert got == {far: (0, 0), others: (0, 1), long: (1, 0), "stemword" + "y" * 500: (3, 0)}
