"""Operator 8: personal data, and terms that disclose it, with DataFrame functions only.

Base spans: e-mail and IP addresses, card and phone numbers, each kind leftmost and without overlaps. Where a
match lies follows from the lengths of what Spark's ``split`` leaves between the matches.

Disclosing terms: an e-mail address, number, ... is a protected entity. A word of a document that holds an entity
discloses it as far as the corpus makes the entity likely once the word is known:

    PMI(entity, word) / IC(entity) = 1 + log p(entity | word) / -log p(entity)

with p from counts of documents over the whole corpus. A word at ``ALPHA`` or more is a
span of kind ``term`` wherever it stands in the corpus, if meeting the entity as often by chance is less likely
than ``CHANCE`` over all pairs that are judged (Chernoff's bound on the binomial tail): every entity with the different
words of each unrelated text that holds it. How often they met is the number of unrelated texts with both: copies are
no evidence and count once (the one of the most words stands for its pairs). Texts are taken for copies of each other
if they agree, by themselves or through others, in ``BAND`` neighbouring ones of ``SIGNS`` MinHash values of the word
pairs outside their entities: 0.99 of the pairs of texts that have 0.7 of their word pairs in common, 0.05 of those
that have a third in common, as a shared passage gives.

Cases: a null text is empty; rows equal in doc_id and text get equal results; a null doc_id is a key like any
other; an empty table gives an empty result; other columns are ignored, or passed along by ``with_spans`` and
``sanitise``, whatever their names. The patterns take what the plain ones take, but start only where a run of
characters starts and never give characters back, so that very long runs cost time in proportion to their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, written
from .graph import connected_components

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
ALPHA, CHANCE = 0.8, 0.01
SIGNS, BAND = 240, 6
#: Candidate words that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_KEY = ["doc_id", "text_key"]
_WORD = r"\p{L}\p{N}"


def _luhn(digits: Column) -> Column:
    def digit(i: Column) -> Column:
        return F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")

    def add(total: Column, i: Column) -> Column:
        twice = digit(i) * 2
        return total + F.when(i % 2 == 1, digit(i)).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .otherwise(F.length(digits).between(8, 15))
    )


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text.alias("text"))


def holding(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text and ``kinds`` (kind, matches with their validity) of the texts that hold personal data."""
    may = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    found = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.when(may.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("matches"))
            for k, p in PATTERNS.items()
        ]
    )
    worth = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), F.transform(s["matches"], lambda m: F.struct(m.alias("value"), _holds(s["kind"], m).alias("ok"))).alias("matches")))
    kinds = F.filter(worth, lambda s: F.exists(s["matches"], lambda m: m["ok"]))
    return _texts(docs).select(*_KEY, "text", kinds.alias("kinds")).where(F.size("kinds") > 0)


def base_spans(held: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, end (code points, end exclusive) and value of every base span of ``holding``'s texts."""
    kinds = held.select(*_KEY, "text", F.explode("kinds").alias("s"))
    gaps = reduce(lambda c, k: c.when(F.col("s.kind") == k, F.split("text", PATTERNS[k], -1)), KINDS[1:], F.when(F.col("s.kind") == KINDS[0], F.split("text", PATTERNS[KINDS[0]], -1)))
    rows = kinds.select(*_KEY, F.col("s.kind").alias("kind"), F.arrays_zip(F.col("s.matches").alias("m"), F.transform(gaps, F.length).alias("gap")).alias("z"))
    single = rows.select(*_KEY, "kind", F.posexplode(F.transform("z", lambda z: F.struct(z["m"]["value"].alias("value"), z["m"]["ok"].alias("ok"), z["gap"].alias("gap")))).alias("pos", "z"))
    single = single.select(*_KEY, "kind", "pos", "z.*").distinct()  # equal rows are one document
    upto = Window.partitionBy(*_KEY, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.length("value"), F.lit(0))
    placed = single.withColumn("end", F.sum(F.col("gap") + size).over(upto)).where("ok")
    return placed.select(*_KEY, "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def _entity() -> Column:
    return F.concat_ws(":", "kind", F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value")))


def _vocabulary(text: Column) -> Column:
    """The different words of three and more characters with a letter, lower-cased, outside e-mail addresses."""
    free = F.regexp_replace(text, F.lit(PATTERNS["email"]), F.lit(" "))
    return F.filter(F.array_distinct(F.split(F.lower(free), f"[^{_WORD}]+")), lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}"))


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _signs(text: Column) -> Column:
    """A hash of every ``BAND`` of ``SIGNS`` MinHash values of a text's pairs of neighbouring words with a letter, outside
    e-mail addresses (of the text, if it has under two)."""
    free = F.regexp_replace(text, F.lit(PATTERNS["email"]), F.lit(" "))
    words = F.filter(F.split(F.lower(free), f"[^{_WORD}]+"), lambda w: w.rlike(r"\p{L}"))
    pairs = _let(words, lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    hashes = _let(pairs, lambda p: F.when(F.size(p) == 0, F.array(F.xxhash64(text))).otherwise(F.array_distinct(p)))
    # A function of two arguments would be given the place of a value as its second one.
    least = lambda p, k: F.array_min(F.transform(p, lambda h: F.xxhash64(h, k)))
    signs = _let(hashes, lambda p: F.transform(F.sequence(F.lit(1), F.lit(SIGNS)), lambda k: least(p, k)))
    return _let(signs, lambda s: F.transform(F.sequence(F.lit(1), F.lit(SIGNS), F.lit(BAND)), lambda at: F.xxhash64(F.slice(s, at, BAND))))


def classes(texts: DataFrame) -> DataFrame:
    """text_key, copy_class of ``texts`` (text_key, text; each once): texts that agree in a band of MinHash values have one class."""
    rows = written(texts.select("text_key", F.posexplode(_signs(F.col("text"))).alias("k", "sign")), "pii-signs")
    least = rows.groupBy("k", "sign").agg(F.min("text_key").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = written(least, "pii-shared-signs")
    linked = connected_components(rows.join(least.hint("merge"), ["k", "sign"]).select(F.col("text_key").alias("a"), F.col("m").alias("b")))
    linked = written(linked.select(F.col("node").alias("text_key"), F.col("component").alias("copy_class")), "pii-classes")
    return rows.select("text_key").distinct().join(linked.hint("merge"), "text_key", "left").select("text_key", F.coalesce("copy_class", "text_key").alias("copy_class"))


def placed(held: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """text_key, text, n_rows (how many have it), n_words (different words) of ``holding``'s texts; and entity, alike, text_key, docs, copy_class of every entity.

    Entities that the same texts hold have the same words: the first of them stands for ``alike`` of them.
    """
    each = written(spans.select(_entity().alias("entity"), *_KEY).distinct().groupBy("entity", "text_key").agg(F.count("*").alias("docs")), "pii-held")
    mark = lambda k: F.xxhash64(F.lit(k), "text_key")
    where = each.groupBy("entity").agg(F.count("*").alias("n"), F.sum(mark(0).cast("decimal(38,0)")).alias("s"), F.bit_xor(mark(1)).alias("x"))
    first = where.groupBy("n", "s", "x").agg(F.min("entity").alias("entity"), F.count("*").alias("alike"))
    each = written(each.join(first.select("entity", "alike", "n").hint("merge"), "entity"), "pii-first")
    once = held.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("n_rows"))
    texts = written(once.withColumn("n_words", F.size(_vocabulary(F.col("text")))), "pii-texts")
    shared = each.where("n > 1").select("text_key").distinct()  # only an entity of several texts can lie in copies
    copies = classes(texts.select("text_key", "text").join(shared.hint("merge"), "text_key"))
    each = each.join(copies.hint("merge"), "text_key", "left").withColumn("copy_class", F.coalesce("copy_class", "text_key"))
    return texts, written(each.select("entity", "alike", "text_key", "docs", "copy_class"), "pii-classed")


def _meetings(words: DataFrame) -> DataFrame:
    """entity, alike, word, both, times from ``words`` (entity, alike, copy_class, docs, word)."""
    by_class = words.groupBy("entity", "alike", "word", "copy_class").agg(F.sum("docs").alias("n"))
    return by_class.groupBy("entity", "alike", "word").agg(F.sum("n").alias("both"), F.count("*").alias("times"))


def met(held: DataFrame, spans: DataFrame) -> DataFrame:
    """entity, alike, word, both (documents that hold them), times (unrelated texts among these), for every entity and word."""
    texts, each = placed(held, spans)
    return _meetings(texts.join(each.hint("merge"), "text_key").select("entity", "alike", "copy_class", "docs", F.explode(_vocabulary(F.col("text"))).alias("word")))


def disclosing(docs: DataFrame, held: DataFrame, spans: DataFrame, alpha: float = ALPHA, chance: float = CHANCE) -> DataFrame:
    """entity, word, disclosure of every word that discloses an entity (the first of those that the same texts hold).

    Only pairs that can pass are listed: a word meets an entity in no more unrelated texts than hold the entity, or the
    word; and a word of many documents discloses an entity of few in none of them.
    """
    texts, each = placed(held, spans)
    by_class = each.join(texts.select("text_key", "n_words").hint("merge"), "text_key").groupBy("entity", "alike", "copy_class").agg(F.sum("docs").alias("docs"), F.max("n_words").alias("n_words"))
    entities = written(by_class.groupBy("entity", "alike").agg(F.sum("docs").alias("holders"), F.count("*").alias("unrelated"), F.sum("n_words").alias("pairs")), "pii-entities")
    limit = math.log((entities.agg(F.sum(F.col("alike") * F.col("pairs"))).head()[0] or 1) / chance)
    n = float(max(docs.count(), 1))
    base = F.col("holders") / n
    rarity = -F.log(base)
    times = F.col("times").cast("double")
    # A word that meets the entity in all of its documents is the least likely to do so by chance.
    able = entities.where((rarity > 0) & (F.col("unrelated") * rarity >= limit))
    able = able.select("entity", "holders", rarity.alias("rarity"), (F.col("holders") * F.exp((1 - alpha) * rarity) * (1 + 1e-9)).alias("most"))  # documents of a word
    each = written(each.join(able.hint("merge"), "entity"), "pii-able")
    asked = each.groupBy("text_key", "copy_class").agg(F.max("rarity").alias("rarity"), F.max("most").alias("most"))
    words = written(texts.join(asked.hint("merge"), "text_key").select("text_key", "copy_class", "rarity", "most", F.explode(_vocabulary(F.col("text"))).alias("word")), "pii-vocabulary")
    wanted = words.groupBy("word", "copy_class").agg(F.max("rarity").alias("rarity"), F.max("most").alias("most"))
    wanted = wanted.groupBy("word").agg(F.count("*").alias("unrelated"), F.max("rarity").alias("rarity"), F.max("most").alias("most"))
    wanted = wanted.where(F.col("unrelated") * F.col("rarity") >= limit).select("word", F.col("most").alias("cap"))
    # What is too common among the texts that hold personal data is so among all, and need not be counted there.
    least = texts.select("n_rows", F.explode(_vocabulary(F.col("text"))).alias("word")).groupBy("word").agg(F.sum("n_rows").alias("n"))
    wanted = written(wanted.join(least, "word").where("n <= cap").select("word", "cap"), "pii-words")
    seen = _texts(docs).select(F.explode(_vocabulary(F.col("text"))).alias("word"))
    if wanted.count() <= BROADCAST_ROWS:
        counted = seen.join(F.broadcast(wanted.select("word")), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:
        counted = seen.groupBy("word").agg(F.count("*").alias("n"))
    counted = written(counted.join(wanted, "word").where("n <= cap").select("word", "n"), "pii-counted")
    left = words.select("text_key", "word").join(counted, "word").join(each.hint("merge"), "text_key").where("n <= most")
    pairs = written(_meetings(left.select("entity", "alike", "copy_class", "docs", "word")), "pii-pairs")
    scored = pairs.join(able, "entity").join(counted, "word").where(times * rarity >= limit)
    given = F.least(F.col("both") / F.col("n"), F.lit(1.0))
    tries = F.greatest(F.col("n") - F.col("both") + times, times)
    missed = tries - times
    surprise = times * F.log(times / (tries * base)) + F.when(missed > 0, missed * F.log(missed / (tries * (1 - base)))).otherwise(0.0)
    scored = scored.withColumn("disclosure", 1 + F.log(given) / rarity)
    return scored.where((F.col("disclosure") >= alpha) & (times > tries * base) & (surprise >= limit)).select("entity", "word", "disclosure")


def term_spans(docs: DataFrame, spans: DataFrame, flagged: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end of every place of a flagged word outside the base spans.

    The flagged words of a document make one pattern, so that only their places are listed.
    """
    terms = written(flagged.select("word").distinct(), "pii-terms")
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    having = _texts(docs).select(*_KEY, F.explode(_vocabulary(F.col("text"))).alias("word")).join(terms, "word")
    having = having.groupBy(*_KEY).agg(F.array_sort(F.collect_set("word")).alias("words")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "words")
    having = written(having, "pii-having")
    texts = _texts(docs).join(having.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    pattern = F.concat(F.lit(f"(?iu)(?<![{_WORD}])(?:"), F.array_join("words", "|"), F.lit(f")(?![{_WORD}])"))
    zipped = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(0)).alias("word"), F.transform(F.split("text", pattern, -1), F.length).alias("gap"))
    rows = texts.select(*_KEY, F.posexplode(zipped).alias("pos", "z")).select(*_KEY, "pos", "z.word", "z.gap").distinct()
    upto = Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("word"), F.lit(0))).over(upto)).where("word is not null")
    places = written(placed.select(*_KEY, (F.col("end") - F.length("word")).alias("start"), "end"), "pii-places")
    inside = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    covered = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("start") < F.col("_end")) & (F.col("end") > F.col("_start"))
    return places.join(inside, covered, "left_anti")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and ``spans``: (order, kind, start, end), sorted, of every text that has any."""
    held = written(holding(docs), "pii-holding")
    base = written(base_spans(held), "pii-base")
    flagged = disclosing(docs, held, base)
    terms = term_spans(docs, base, flagged).select(*_KEY, F.lit(len(KINDS)).alias("order"), F.lit("term").alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    order = reduce(lambda c, i: c.when(F.col("kind") == KINDS[i], i), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    every = base.select(*_KEY, order.alias("order"), "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).union(terms)
    return every.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("order", "start", "end", "kind"))).alias("spans"))


_NONE = "array<struct<order:int,start:bigint,end:bigint,kind:string>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``; empty where there is nothing to hide."""
    base = docs.drop("spans")
    i, k = free_names(base, "id", "key")
    found = written(find(docs), "pii-spans").select(F.col("doc_id").alias(i), F.col("text_key").alias(k), "spans")
    joined = base.join(found.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k)), "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(_NONE))).drop(i, k)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """A row per document: counts by kind, the digest of the base spans, all spans as text, how many spans were
    replaced in the sanitised text (those that overlap an earlier one go with it) and that text's digest."""
    out = sanitise(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in (*KINDS, "term")], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.col("n_replaced"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``, ``clean_text``: each span replaced by the name of its kind in brackets, the earlier one
    where spans overlap, and ``n_replaced``, the number of brackets. Columns of these names are replaced."""
    marked = with_spans(docs.drop("clean_text", "n_replaced"))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = F.struct(F.array().cast("array<struct<skip:bigint,to:bigint,kind:string>>").alias("cuts"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        cut = F.struct(a["at"].alias("skip"), s["start"].alias("to"), s["kind"].alias("kind"))
        return F.when(s["start"] >= a["at"], F.struct(F.concat(a["cuts"], F.array(cut)).alias("cuts"), s["end"].alias("at"))).otherwise(F.struct(a["cuts"].alias("cuts"), F.greatest(a["at"], s["end"]).alias("at")))

    def put(a: Column) -> Column:
        between = F.transform(a["cuts"], lambda c: F.concat(F.substring(text, c["skip"].cast("int") + 1, (c["to"] - c["skip"]).cast("int")), F.lit("["), F.upper(c["kind"]), F.lit("]")))
        whole = F.concat(F.array_join(between, ""), F.substring(text, a["at"].cast("int") + 1, F.length(text)))
        return F.struct(whole.alias("text"), F.size(a["cuts"]).cast("long").alias("n"))

    (made,) = free_names(marked, "made")
    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    out = marked.withColumn(made, F.when(F.size("spans") == 0, same).otherwise(F.aggregate(by_start, first, step, put)))
    return out.withColumns({"clean_text": F.col(made)["text"], "n_replaced": F.col(made)["n"]}).drop(made)
