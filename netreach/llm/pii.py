r"""Personal data, by patterns and by what words near them disclose about them.

Base spans are e-mail and IP addresses, card and phone numbers, found in the whole text: leftmost, not overlapping within
a kind; matches that fail their check (parts of an address, digits, Luhn) are dropped and not tried again.

The method adds spans of words (information-theoretic sanitisation). An entity is a base span's value. A word is a run of
letters outside the base spans, of any length. Every word of a text that holds the entity is a candidate. Over the whole
corpus, with n texts, of which n_e hold the entity, n_t the word, and n_et both, a word discloses of the entity's information

    ln(p n / n_e) / ln(n / n_e)

where p is the share n_et / n_t of the word's texts that hold the entity. It would be 1 if the word is in no other text; as
few texts say little, p is taken at its lower confidence bound (Wilson's, ``TRUST`` standard errors), so rare entities are
judged too, by what their texts can tell. A pair is removed (kind ``term``) from ``remove`` on, and generalised (kind
``general``) from ``generalise`` on, at every place in the texts that hold the entity.
Base spans stay as they are. In scripts without spaces a run of letters is a word, so names within it are not told apart.

All of it is DataFrame operations. Positions come from the text's pieces between matches, in code points, end exclusive.
Patterns use possessive quantifiers and start only where a run of their letters starts, so a run of any length is read
once and without recursion; they match what the plain forms match. Pairs and words are counted before they are
joined; only texts with an entity give pairs. A null text is empty. Rows with equal id and text share their result;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netreach.llm.common import stage, text_or_empty

KINDS = ["email", "ip", "card", "phone", "term", "general"]
#: For each base kind: its pattern, and a quick test that a text must pass to hold one.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
REMOVE, GENERALISE, TRUST = 0.95, 0.8, 0.7
WORD = r"\p{L}++"
#: Matches that are placed at a time, so that the work grows with a text's matches and not with their square.
BLOCK = 256


def found_blocks(text: Column, pattern: str) -> Column:
    """Matches in order, in blocks: struct(at, out: struct(start, end, value)), places in a block being from its ``at``."""
    gaps, values = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    out = "array<struct<start:int,end:int,value:string>>"
    kind = f"struct<at:int,out:{out}>"

    def step(acc: Column, x: Column) -> Column:
        # a piece is the text up to a match, and the match; the last has none
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        own = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        more = F.when(x["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(own)))
        return F.struct(end.alias("at"), more.alias("out")).cast(kind)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(out).alias("out")).cast(kind)
    # the pieces as a variable, so that they are cut once and not for each block
    blocks = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(p, k * BLOCK + 1, F.lit(BLOCK)), empty, step)))[0]
    whole = f"struct<at:int,out:array<{kind}>>"

    def place(acc: Column, x: Column) -> Column:
        own = F.struct(acc["at"].alias("at"), x["out"].alias("out"))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(own)).alias("out")).cast(whole)

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")).cast(whole)
    return F.aggregate(blocks, none, place)["out"]


def found(text: Column, pattern: str) -> Column:
    """Matches in order: struct(start, end, value)."""
    return F.flatten(F.transform(found_blocks(text, pattern), lambda b: F.transform(b["out"], lambda y: F.struct(
        (b["at"] + y["start"]).alias("start"), (b["at"] + y["end"]).alias("end"), y["value"].alias("value")))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits sum to a multiple of ten, every second from the right doubled (and 9 less if that is over 9)."""
    each = F.transform(F.split(F.reverse(number), ""), lambda x, k: F.when(k % 2 == 0, x.cast("int")).otherwise(
        x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))
    if kind == "card":
        number = digits(value)
        return F.length(number).between(12, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid base spans by start, then kind: struct(start, rank, end, kind, value)."""
    def of_kind(rank: int, kind: str) -> Column:
        pattern, test = PATTERNS[kind]
        kept = F.filter(found(text, pattern), lambda x: valid(kind, x["value"]))
        whole = F.transform(kept, lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"),
            x["value"].alias("value")))
        return F.when(F.regexp_like(text, F.lit(test)), whole).otherwise(F.array().cast(SPANS))

    parts = [of_kind(rank, kind) for rank, kind in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*parts))


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def entity_of(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"])))


def words_of(text: Column) -> Column:
    """The words of a text, each spelling once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def without(text: Column, spans: Column) -> Column:
    """``text`` with a digit for each letter of ``spans``, so places stay."""
    acc = lambda at, out: F.struct(at.cast("int").alias("at"), out.cast("string").alias("out"))
    return F.aggregate(spans, acc(F.lit(0), F.lit("")), lambda a, x: F.when(x["end"] > a["at"], acc(x["end"], F.concat(
        a["out"], F.substring(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0))),
        F.repeat(F.lit("0"), x["end"] - F.greatest(x["start"], a["at"]))))).otherwise(a),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def same_row(left: str = "_doc", right: str = "_key") -> Column:
    return F.col("doc_id").eqNullSafe(F.col(left)) & (F.col("text_key") == F.col(right))


def holding_texts(docs: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, free: text without its base spans, entities) of the texts that hold an entity, each once, and
    (entity, n_e) of the entities."""
    spans = base.where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    places = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    own = stage(spans.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.array_distinct(F.transform("spans", entity_of)).alias("entities"), places.alias("places")), "holding")
    entities = stage(own.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")), "entities")
    tests = F.lit(False)
    for _, test in PATTERNS.values():
        tests = tests | F.regexp_like(F.col("text"), F.lit(test))
    texts = docs.where(tests).select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), "text")
    # rows of any width: Spark broadcasts the side only if its bytes are few
    texts = texts.join(own, same_row()).dropDuplicates(["doc_id", "text_key"])
    return stage(texts.select("doc_id", "text_key", without(F.col("text"), F.col("places")).alias("free"), "entities"), "texts"), entities


def lower_bound(share: Column, n: Column) -> Column:
    """Wilson's lower bound of a share seen in ``n`` texts."""
    z = TRUST * TRUST
    return (share + z / (2 * n) - TRUST * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def disclosures(docs: DataFrame, texts: DataFrame, entities: DataFrame, least: float) -> DataFrame:
    """(entity, term, disclosure) of the pairs that disclose at least ``least``."""
    lowered = lambda words: F.array_distinct(F.transform(words, F.lower))
    each = texts.select(F.explode("entities").alias("entity"), lowered(words_of(F.col("free"))).alias("words"))
    pairs = stage(each.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et")), "pairs")
    wanted = stage(pairs.select("term").distinct(), "terms")
    # counted before the join, so it meets a row for each word of the vocabulary, not for each use
    terms = docs.select(F.explode(lowered(words_of(text_or_empty()))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term")
    total = docs.count()
    joined = pairs.join(entities, "entity").join(terms, "term")
    information = F.log(F.lit(float(total)) / F.col("n_e"))
    # a base span's own letters are no words of its text, so a word can be free in more texts than the raw ones say
    n_t = F.greatest("n_t", "n_et")
    told = 1 + F.log(lower_bound(F.col("n_et") / n_t, n_t)) / F.when(information > 0, information)
    return joined.select("entity", "term", told.alias("disclosure")).where(F.col("disclosure") >= least)


def marks(texts: DataFrame, told: DataFrame, remove: float) -> DataFrame:
    """(_doc, _key, extra: struct(start, rank, end, kind) of every place of the words that disclose an entity of the text)."""
    rank = F.when(F.col("disclosure") >= remove, 4).otherwise(5)
    uses = texts.select("doc_id", "text_key", F.explode("entities").alias("entity"), F.array_distinct(F.transform(words_of(F.col("free")), F.lower)).alias("words"))
    uses = uses.select("doc_id", "text_key", "entity", F.explode("words").alias("term"))
    # a word may disclose several entities: its strongest mark holds
    own = uses.join(told, ["entity", "term"]).groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("term").alias("_term")).agg(F.min(rank).alias("rank"))
    places = texts.select("doc_id", "text_key", F.explode(found_blocks(F.col("free"), WORD)).alias("block"))
    places = places.select("doc_id", "text_key", F.col("block.at").alias("at"), F.explode("block.out").alias("word"))
    met = places.join(own, same_row() & (F.lower("word.value") == F.col("_term")))
    span = F.struct((F.col("at") + F.col("word.start")).alias("start"), F.col("rank"), (F.col("at") + F.col("word.end")).alias("end"),
                    F.when(F.col("rank") == 4, "term").otherwise("general").alias("kind"))
    return met.groupBy("_doc", "_key").agg(F.collect_list(span).alias("extra"))


def personal_data(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(doc_id, text_key, spans: all of them by start, then kind; base: the base ones) of every row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = stage(slim.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), base_spans(text_or_empty()).alias("spans")), "base-spans")
    texts, entities = holding_texts(slim, base)
    told = stage(disclosures(slim, texts, entities, generalise), "disclosures")
    extra = marks(texts, told, remove)
    plain = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    both = base.select("doc_id", "text_key", plain.alias("base")).join(extra, same_row(), "left")
    return both.select("doc_id", "text_key", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))).alias("spans"), "base")


def digest_columns(found_: DataFrame) -> DataFrame:
    """The counts and digests of the result of ``personal_data``."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found_.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with spans replaced: base spans by <kind>, words by nothing or, if generalised, by <word>."""
    marks = personal_data(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "spans").distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text_or_empty()).alias("text_key"))
    put = lambda x: F.when(x["kind"] == "term", "").when(x["kind"] == "general", "<word>").otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">")))
    acc = lambda at, out: F.struct(at.cast("int").alias("at"), out.cast("string").alias("out"))
    rebuilt = F.aggregate("spans", acc(F.lit(0), F.lit("")), lambda a, x: F.when(
        x["start"] >= a["at"], acc(x["end"], F.concat(a["out"], F.substring("text", a["at"] + 1, x["start"] - a["at"]), put(x)))
    ).otherwise(acc(F.greatest(a["at"], x["end"]), a["out"])), lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    both = text.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    return both.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))
