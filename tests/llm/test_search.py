"""Personal data, licences, benchmark items: against plain Python."""
import hashlib
import math
import random
import re

import numpy as np
import pytest
import regex
from conftest import words

from netreach.llm import decontamination, license_scan, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(number) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(number))) % 10 == 0
    return kind == "email" or 9 <= len(number) <= 15


def base(text):
    spans = sorted((m.start(), r, k, m.end()) for r, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m.group()))
    return [f"{k}:{a}:{b}" for a, _, k, b in spans]


def test_base_spans(docs_of, messy, nothing):
    rng = random.Random(4)
    parts = ["a@b.c", "a@b.c_d@e.fg", "x.y@-.z", "@@a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4539 1488 0343 6467", "4539-1488 0343-6467", "+1 (212) 555-0100",
             "+4", "+12345678", "+1+1 222 333 4444", "4111111111111111", "😀", "é", " ", ".", "@", "-", "1", "+", "\n", "0000000000000000000000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    got = {r.doc_id: r for r in pii.digest_columns(pii.personal_data(docs_of(texts))).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(got[i].spans.split(",")) or not want
        assert got[i].n_email == sum(x.startswith("email") for x in want)
    rows = pii.digest_columns(pii.personal_data(messy)).collect()
    assert len(rows) == messy.count() and all(r.base_sha256 for r in rows)
    assert pii.digest_columns(pii.personal_data(nothing)).count() == 0


def test_words_that_disclose_an_entity(docs_of):
    rng = random.Random(5)
    texts = [f"{words(rng, 20)} Zanzibar a.b@c.org today {words(rng, 5)}" for _ in range(4)] + [f"today {words(rng, 30)}" for _ in range(60)]
    rows = {r.doc_id: r for r in pii.personal_data(docs_of(texts)).collect()}
    for i in range(4):
        marked = {texts[i][x.start:x.end]: x.kind for x in rows[i].spans}
        assert marked["Zanzibar"] == "term" and "today" not in marked and marked["a.b@c.org"] == "email"
    assert all(not rows[i].spans for i in range(4, 64))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(texts)).collect()}
    assert "<email>" in clean[0] and "Zanzibar" not in clean[0] and clean[10] == texts[10]


def test_licence_blocks_and_base_places(docs_of, messy, nothing):
    rng = random.Random(6)
    filler = lambda n: words(rng, n)
    texts = [
        f"{filler(200)} Licensed under the Apache License, Version 2.0. {filler(90)}", f"{filler(31)} RELEASED under the MIT license", "CC BY, cc-by; cc by", "cc", None, "",
        "all rights reserved all rights reserved", f"general public {filler(3)} license", f"{filler(500)} version of the license under apache", "permission is hereby granted to any person",
    ]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(texts)).collect()}
    assert got[0].labels == "apache-2.0" and got[0].n_base == 0 and got[0].first_word is None and got[0].score == 1.0
    assert got[1].labels == "mit"
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels, got[2].score) == (3, 0, 4, "cc-by", 1.0)
    assert [(got[i].n_words, got[i].labels, got[i].score) for i in (4, 5)] == [(0, "", 0.0)] * 2
    assert got[6].n_base == 2 and got[6].base_labels == "reserved" and not got[7].n_base
    # every block against every template, without filters
    for i, t in enumerate(texts):
        own = license_scan.words_of(t)
        best = {}
        for label, (template, must) in license_scan.TEMPLATES.items():
            need = set(template.split())
            for k in range(0, len(own) + 1, license_scan.STEP):
                block = set(own[k:k + license_scan.BLOCK])
                if set(must.split()) <= block and len(need & block) >= license_scan.THRESHOLD * len(need):
                    best[label] = max(best.get(label, 0), len(need & block) / len(need))
        labels = set(best) | {x for x in got[i].base_labels.split(",") if x}
        assert got[i].labels == ",".join(sorted(labels))
        assert got[i].n_base or got[i].score == max(best.values(), default=0)
    assert license_scan.scan(messy).count() == messy.count()
    assert license_scan.scan(nothing).count() == 0


def distance_to_part(item, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_least_edits():
    rng = random.Random(7)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert decontamination.least_edits(item, text) == distance_to_part(item, text)


def test_decontamination(spark, docs_of, messy, nothing):
    rng = random.Random(8)
    items = [" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 8))) for _ in range(n)) for n in (14, 20, 30, 45, 60)] + ["tiny", None, "  "]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, want = [], []
    for i in range(5):
        for edits in (0, 1, int(0.04 * len(items[i]))):
            own = list(items[i])
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice("xyz")
            texts.append(f"{words(rng, 40)} {''.join(own)}\n {words(rng, 40)}")
            want.append(i)
        texts += [items[i].upper().replace(" ", "\n"), " ".join(reversed(items[i].split())), items[i][:len(items[i]) // 2]]
        want += [i, None, None]
    texts += ["a TINY text", words(rng, 400)]
    want += [5, None]
    got = {r.doc_id: r for r in decontamination.contaminated(docs_of(texts), benchmark).collect()}
    found = [got[i].items == ("" if w is None else str(w)) for i, w in enumerate(want)]
    assert sum(found) >= 0.95 * len(found) and all(got[i].items == "" for i, w in enumerate(want) if w is None)
    assert decontamination.drop_contaminated(messy, benchmark).count() == messy.count()
    assert decontamination.drop_contaminated(messy, benchmark).columns == messy.columns
    assert decontamination.contaminated(messy, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.contaminated(nothing, benchmark).count() == 0


def test_items_that_begin_anywhere():
    rng = random.Random(11)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    items = [" ".join(letters(rng.randrange(2, 8), "abcdefghijklmno") for _ in range(n)) for n in (14, 20, 30, 45) for _ in range(5)]
    items += [letters(n, "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往") for n in (40, 100, 200) for _ in range(3)]
    finder = decontamination.Finder(list(enumerate(items)))
    for i, item in enumerate(items):
        for glued in (1, 7, 20, 60, 400):
            before, after = letters(glued, "pqrstuv"), letters(50, "pqrstuv")
            assert finder.find(before + item + after) == {i: 0}
    # the starts are those of all windows with enough known runs
    text = letters(30, "pq") + items[3][:60] + letters(9, "pq") + items[3][40:] + items[9] + letters(90, "pq")
    _, windows = finder.windows(text)
    known = finder.known[decontamination.Q][decontamination.run_slots(decontamination.codes(text), slots=finder.slots)]
    for k, group in enumerate(finder.classes):
        own = ((known >> np.uint64(k % 64)) & np.uint64(1)).astype(int).tolist()
        want = [s for s in range(len(text)) if sum(own[s:s + group.length - decontamination.Q + 1]) >= group.least_runs]
        assert windows[k].tolist() == want


def test_runs_of_short_items_leave_room_for_an_edit():
    rng = random.Random(13)
    for n in (17, 18, 19):
        item = "".join(rng.choice("abcdefghijklmno") for _ in range(n))
        for others in ([], ["".join(rng.choice("pqrstuv") for _ in range(16))]):
            finder = decontamination.Finder(list(enumerate([item, *others])))
            for k in range(n):
                _, windows = finder.windows("zzzzz" + item[:k] + "y" + item[k + 1:] + "z" * 40)
                assert windows and any(5 in w for w in windows)


def test_disclosing_words_are_marked_everywhere(docs_of):
    rng = random.Random(12)
    texts = [f"Zanzibar {words(rng, 40)} a.b@c.org {words(rng, 40)} zanzibar, Li {words(rng, 40)} 😀 ZANZIBAR" for _ in range(4)]
    # over sixty letters away in every text, at its start and its end, and short
    texts += [f"Quorn {words(rng, 30)} +1 212 555 0100 {words(rng, 30)} 王芳" for _ in range(3)] + [f"{words(rng, 60)} Lima" for _ in range(60)]
    rows = {r.doc_id: r for r in pii.personal_data(docs_of(texts)).collect()}
    marked = lambda i: [texts[i][x.start:x.end] for x in rows[i].spans if x.kind == "term"]
    assert all(marked(i) == ["Zanzibar", "zanzibar", "Li", "ZANZIBAR"] for i in range(4))
    assert all(marked(i) == ["Quorn", "王芳"] for i in range(4, 7))
    assert not any(rows[i].spans for i in range(7, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(texts)).collect()}
    assert "zanzibar" not in clean[0].lower() and " Li " not in clean[0] and "Quorn" not in clean[4]


def plain_disclosures(texts):
    """{text: spans of the method} by counting, word for word."""
    word = regex.compile(r"\p{L}+")
    held, free = [], []
    for t in texts:
        own, cut = set(), t
        for kind, a, b in (x.split(":") for x in base(t)):
            value = t[int(a):int(b)]
            own.add((kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()))
            cut = cut[:int(a)] + "0" * (int(b) - int(a)) + cut[int(b):]
        held.append(own)
        free.append(cut)
    raw = [{w.lower() for w in word.findall(t)} for t in texts]
    clear = [{w.lower() for w in word.findall(t)} for t in free]
    n, z = len(texts), pii.TRUST ** 2

    def told(entity, term):
        n_e, n_et = sum(entity in h for h in held), sum(entity in h and term in c for h, c in zip(held, clear, strict=True))
        n_t = max(n_et, sum(term in r for r in raw))
        if n_e == n:
            return 0
        p = n_et / n_t
        low = (p + z / (2 * n_t) - math.sqrt(z) * math.sqrt(p * (1 - p) / n_t + z / (4 * n_t * n_t))) / (1 + z / n_t)
        return 1 + math.log(low) / math.log(n / n_e)

    out = []
    for h, c, t in zip(held, clear, free, strict=True):
        best = {w: max((told(e, w) for e in h), default=0) for w in c}
        marked = [(m.start(), m.end(), best[m.group().lower()]) for m in word.finditer(t)]
        out.append([f"{'term' if d >= pii.REMOVE else 'general'}:{a}:{b}" for a, b, d in marked if d >= pii.GENERALISE])
    return out


def test_disclosures_against_counting(docs_of):
    rng = random.Random(21)
    entities = ["a.b@c.org", "A.B@C.org", "10.1.2.3", "+1 212 555 0100", "x@y.zz"]
    names = ["Quorn", "quorn", "Zanzibar", "Ünal", "王芳", "Lima", "Oslo", "x"]
    texts = []
    for i in range(150):
        own = words(rng, 12).split() + rng.sample(names, rng.randrange(3))
        if i % 3 == 0:
            own += rng.sample(entities, rng.randrange(1, 3)) + [rng.choice(names[:3]), f"only{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}"]
        rng.shuffle(own)
        texts.append(" ".join(own))
    # an entity in one text only, with a word of its own; a text of hundreds of marked places
    # a word that is well known to disclose one
    texts += [f"{words(rng, 6)} Zorro zorro@six.org"] * 6
    texts += ["Rarely rare@one.org Rarely", " ".join(["Xanadu"] * 700) + " many@one.org"]
    want = plain_disclosures(texts)
    got = {r.doc_id: [f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.kind in ("term", "general")] for r in pii.personal_data(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(want[-1]) == 700 and want[-2] and {x.partition(":")[0] for w in want for x in w} == {"term", "general"}


def test_blocks_without_telling_words(docs_of):
    texts = [
        "Licensed under the Apache License, Version 1.0", "licensed under cc by sa 4 0", "the GNU general public license", "licensed under cc by 4 0",
        # at the threshold and below it
        "confidential and proprietary do not distribute without", "confidential proprietary do not without permission", "confidential proprietary do not permission",
    ]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(texts)).collect()}
    assert (got[0].labels, got[0].score) == ("apache-2.0", 7 / 8)
    # one edition tells itself from the other; neither is told in the fourth
    assert got[1].labels == "cc-by,cc-by-sa" and got[3].labels == "cc-by"
    assert got[2].labels == "gpl"
    assert (got[4].labels, got[4].score) == ("proprietary", 7 / 8)
    assert (got[5].labels, got[6].labels, got[6].score) == ("", "", 0.0)
    blocks = [tuple(r) for r in license_scan.matching_blocks(docs_of(["x " * 40 + texts[0], texts[6], None])).collect()]
    assert sorted(blocks) == [(0, "apache-2.0", 0, 7 / 8, False), (0, "apache-2.0", 32, 7 / 8, False)]


@pytest.mark.parametrize("length", [60, 130, 400])
def test_recall_at_the_edits_allowed(length):
    """Items with as many random edits as are allowed, somewhere in a text: at least 0.95 of them found."""
    rng = random.Random(length)
    letter = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    items = [decontamination.plain("q" + letter(length - 2) + "q") for _ in range(120)]
    finder = decontamination.Finder(list(enumerate(items)))
    found = within = 0
    for k, item in enumerate(items):
        own = list(item)
        for _ in range(int(decontamination.EDITS * len(item))):
            at = rng.randrange(len(own))
            own[at:at + 1] = rng.choice([[], [rng.choice("xyz")], [own[at], rng.choice("xyz")]])
        text = decontamination.plain(letter(80) + "".join(own) + letter(80))
        # spaces that fall together are an edit more
        if decontamination.least_edits(item, text) <= decontamination.EDITS * len(item):
            within += 1
            found += k in finder.find(text)
    assert within > 60 and found >= 0.95 * within, (found, within)
