"""The table of frequent shingles comes from a sample; it orders shingles and decides no link."""
import random

import numpy as np

from netreach.llm import ngram_join
from netreach.llm.shingles import shingle_set


def test_classes_do_not_depend_on_the_sample(spark, docs_of, monkeypatch):
    r = random.Random(5)
    common = " ".join(f"common{i}" for i in range(12))
    texts = []
    for k in range(12):
        own = [f"w{k}x{i}" for i in range(60)]
        for _ in range(4):
            w = list(own)
            w[r.randrange(60)] = "changed"
            texts.append(common + " " + " ".join(w))
    sets = [set(shingle_set(t, 4)[1].tolist()) for t in texts]
    every = np.array(sorted(set().union(*sets)), np.uint64)
    tables = {"none": every[:0], "all": every, "half": every[::2]}
    found = {}
    for name, token in tables.items():
        counts = np.array([r.randrange(10, 99) for _ in token], np.int64)
        monkeypatch.setattr(ngram_join, "frequent_shingles", lambda docs, width, t=token, c=counts: (t, c))
        got = ngram_join.jaccard_classes(docs_of(texts), 4, 80)
        found[name] = sorted((x.doc_id, x.component_id) for x in got.select("doc_id", "component_id").collect())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert len(set(label)) < len(texts)
    assert all(f == list(enumerate(label)) for f in found.values())
