"""Toxicity by a learned lexicon: misspelled terms too, and quotation told from abuse by a context window.

1. The lexicon is learned from a bounded sample of labelled texts: words, and word beginnings of three letters or more,
   that are in significantly many toxic texts and in few others; copies of a text count once. Like counts along a
   beginning are one term, its longest form; words that are significant themselves stay beside their beginning. Every
   significant term is kept.
2. All terms stand in tries, which are met with Levenshtein automata (``lexicon``): one edit for words and word beginnings
   of five letters, two from nine on.
3. Each hit is read in its context: inside quotation marks or beside a word of report it counts as quoted; beside a word
   of address it counts as aimed. A logistic model over exact, misspelled, quoted and aimed hits gives the score. A
   misspelled hit is weighed as an exact one unless the labels say otherwise.

Null and empty texts have no hits and get the score of a text without hits. Whole texts are read, a few at a time, so
memory does not depend on them. Without labelled rows of both classes there is no lexicon and every score is 0. Repeated
rows give rows each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netreach.llm.common import stage, text_or_empty
from netreach.llm.labelled import held_out, training_texts
from netreach.llm.lexicon import Matcher, Term

#: Labelled texts of each class that the lexicon and the model are learned from, at most.
TRAINING = 4_000
#: A term is in at least so many distinct toxic texts of the sample, and so many times as often there as elsewhere.
LEAST_TEXTS, LEAST_RATIO = 3, 20.0
#: Forms as common as a term that would be as toxic by chance, at most, if labels were dealt at random.
CHANCE = 0.1
#: Letters of word beginnings.
SHORTEST, LONGEST = 3, 8
#: Letters around a hit that are read for quotation marks, and words that are read for report or address.
QUOTE_SPAN, CONTEXT = 80, 4
#: Characters of text that are cut into words at a time.
CHUNK = 1_000_000

WORD = re.compile(r"[^\W\d_]+")
REPORT = frozenset("said says say called calls wrote writes quote quoted word term sagte schrieb wort zitat dit écrit mot dijo escribió palabra".split())
ADDRESS = frozenset("you your you're du dein dich euch tu te toi vous votre tú usted ustedes".split())
OPEN, CLOSE = "\"“„«‹‘", "\"”“»›’"
FEATURES = ["exact", "misspelled", "quoted", "aimed", "dense", "one"]


@dataclass
class Model:
    matcher: Matcher = field(default_factory=lambda: Matcher([]))
    ordinary: frozenset[str] = frozenset()
    weights: np.ndarray | None = None


def log_rate(hit, other, toxic: int, clean: int):
    return np.log((hit + 0.5) / (toxic + 1)) - np.log((other + 0.5) / (clean + 1))


def chance(hit: int, other: int, toxic: int, clean: int) -> float:
    """How likely at least ``hit`` of the texts with a form are toxic, if each is so with the sample's share."""
    n, p = hit + other, toxic / (toxic + clean)
    at = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    return sum(math.exp(at(k)) for k in range(hit, n + 1))


def significant(hit: int, other: int, toxic: int, clean: int, as_common: int) -> bool:
    """Whether a form is toxic beyond chance, where ``as_common`` forms are in as many texts or more."""
    if hit < LEAST_TEXTS or log_rate(hit, other, toxic, clean) < np.log(LEAST_RATIO):
        return False
    return chance(hit, other, toxic, clean) * as_common <= CHANCE


def choose_terms(good: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> list[Term]:
    """Terms from significant (text, stem, toxic texts, other texts); a stem gives way to a longer form that has nearly its texts.

    The good words that begin with a chosen stem come along with it.
    """
    texts = {(t, s): a for t, s, a, _ in good}
    weight = {(t, s): float(log_rate(a, b, toxic, clean)) for t, s, a, b in good}
    # the most texts of a longer form, for each beginning
    longer: dict[str, int] = {}
    for (text, stem), a in texts.items():
        for n in range(SHORTEST, min(len(text), LONGEST) + 1):
            if not stem or n < len(text):
                longer[text[:n]] = max(longer.get(text[:n], 0), a)
    chosen: set[tuple[str, bool]] = set()
    beside: dict[str, list[str]] = {}
    for text, stem in sorted(texts, key=lambda x: (len(x[0]), not x[1])):
        above = next((text[:n] for n in range(SHORTEST, min(len(text), LONGEST) + 1) if (text[:n], True) in chosen), None)
        if above is not None:
            if not stem and text != above:
                beside.setdefault(above, []).append(text)
        elif not stem or longer.get(text, 0) < 0.9 * texts[text, stem]:
            chosen.add((text, stem))
    out: list[Term] = []
    for text, stem in sorted(chosen, key=lambda x: (-texts[x] * weight[x], x)):
        out.append(Term(text, stem, weight[text, stem]))
        if stem:
            out += [Term(x, False, weight[x, False]) for x in beside.get(text, ())]
    return out


def learn_terms(texts: DataFrame) -> tuple[Matcher, frozenset[str]]:
    """The lexicon, and words that resemble a term but are ordinary ones: in several clean texts of the sample."""
    texts = texts.select("label", "text", F.xxhash64(text_or_empty()).alias("doc_id")).dropDuplicates(["label", "doc_id"])
    sizes = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Matcher([]), frozenset()
    word = texts.select("label", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}]+"), F.lit(0)))).alias("word"))
    begins = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.struct(F.substring("word", F.lit(1), n).alias("text"), F.lit(True).alias("stem"), n.alias("n")))
    forms = F.concat(F.filter(begins, lambda x: x["n"] <= F.length("word")), F.array(F.struct(F.col("word").alias("text"), F.lit(False).alias("stem"), F.length("word").alias("n"))))
    forms = word.select("label", "doc_id", F.explode(forms).alias("f")).select("label", "doc_id", "f.text", "f.stem").distinct()
    counts = forms.groupBy("text", "stem").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    counts = stage(counts.where("a >= 2 OR b >= 2"), "forms")
    toxic, clean = sizes[1], sizes[0]
    # a row for each number of texts, at most as many as the sample has
    many = sorted(((r.n, r["count"]) for r in counts.groupBy((F.col("a") + F.col("b")).alias("n")).count().collect()), reverse=True)
    as_common, total = {}, 0
    for n, forms_of_n in many:
        total += forms_of_n
        as_common[n] = total

    def good(batches):
        for batch in batches:
            kept = [significant(a, b, toxic, clean, as_common[a + b]) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    rows = counts.where(F.col("a") >= LEAST_TEXTS).mapInArrow(good, counts.schema).collect()
    matcher = Matcher(choose_terms([(r.text, r.stem, r.a, r.b) for r in rows], toxic, clean))
    shared = texts.sparkSession.sparkContext.broadcast(cloudpickle.dumps(matcher))  # words of the sample, by value

    def resemble(batches):
        matcher = pickle.loads(shared.value)
        for batch in batches:
            found = matcher.match(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, (_, edits) in found.items() if edits], pa.string())})

    ordinary = counts.where("NOT stem AND b >= 2 AND b >= a").select("text").mapInArrow(resemble, "word string").collect()
    return matcher, frozenset(r.word for r in ordinary)


def quoted(text: str, start: int, end: int) -> bool:
    """Inside one pair of quotation marks: an opening one before, on the same line, and a closing one after."""
    before = text[max(0, start - QUOTE_SPAN):start].rpartition("\n")[2]
    after = text[end:end + QUOTE_SPAN].partition("\n")[0]
    opened = max(before.rfind(x) for x in OPEN)
    closed = [k for k in (after.find(x) for x in CLOSE) if k >= 0]
    if opened < 0 or not closed:
        return False
    mark = before[opened]
    return mark != '"' or before.count('"') % 2 == 1


def scorer(matcher: Matcher, ordinary: frozenset[str]):
    """A function from texts to a matrix of FEATURES."""
    weight = {t: t.weight for t in matcher.terms}

    def features(texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        out[:, -1] = 1
        lowered = [(x or "").lower() for x in texts]
        at = 0
        while at < len(lowered):
            upto, size = at, 0
            while upto < len(lowered) and (upto == at or size + len(lowered[upto]) <= CHUNK):
                size += len(lowered[upto])
                upto += 1
            words = [WORD.findall(x) for x in lowered[at:upto]]
            known = list(set().union(*words))
            hits = {w: (matcher.terms[k], e) for w, (k, e) in matcher.match(known).items() if not e or w not in ordinary}
            for k, own in enumerate(words):
                if not hits or hits.keys().isdisjoint(own):
                    continue
                text = lowered[at + k]
                row = out[at + k]
                for i, m in enumerate(WORD.finditer(text)):
                    hit = hits.get(m.group())
                    if hit is None:
                        continue
                    around = own[max(0, i - CONTEXT):i + CONTEXT + 1]
                    w = min(weight[hit[0]], 5.0) / 5.0
                    if quoted(text, m.start(), m.end()) or not REPORT.isdisjoint(around):
                        row[2] += w
                    else:
                        row[1 if hit[1] else 0] += w
                        row[3] += not ADDRESS.isdisjoint(around)
                row[4] = row[:3].sum() / np.sqrt(len(own))
            at = upto
        out[:, :5] = np.log1p(out[:, :5])
        return out

    return features


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the weight of misspelled hits is drawn to that of exact ones."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], 1.0)
    pull[-1] = 1e-3
    link = np.zeros((x.shape[1], x.shape[1]))
    link[np.ix_([0, 1], [0, 1])] = 20.0 * np.array([[1, -1], [-1, 1]])
    ridge = np.diag(pull) + link
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, most: int = TRAINING) -> Model:
    texts = training_texts(docs, labels, "toxic", folds, fold, most)
    matcher, ordinary = learn_terms(texts)
    if not matcher.terms:
        return Model()
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((matcher, ordinary)))  # words of the sample

    def run(batches):
        features = scorer(*pickle.loads(shared.value))
        for batch in batches:
            x = features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(x), pa.list_(pa.float64())), "label": batch.column(1)})

    rows = texts.select("text", "label").mapInArrow(run, "x array<double>, label int").collect()  # at most 2 x most
    return Model(matcher, ordinary, fit(np.array([r.x for r in rows]), np.array([r.label for r in rows], float)))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``; docs need ``text``."""
    found = docs.select(*keep, F.col("text").alias("_text"))
    if model.weights is None:
        return found.withColumn("score", F.lit(0.0)).drop("_text")
    weights, n = model.weights, len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((model.matcher, model.ordinary)))

    def run(batches):
        features = scorer(*pickle.loads(shared.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = features(part.column(n).to_pylist())
                s = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(s)], names=[*keep, "score"])

    schema = found.drop("_text").withColumn("score", F.lit(0.0)).schema
    return found.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), ["doc_id"])
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return score(rows, train(docs, labels), ["_row"]).where("score < 0.5").select("_row.*")
