"""Personal data, and terms that would give it away, found and generalised in DataFrame operations only.

Base spans come from four patterns. On top of them a corpus model decides which terms reveal a protected entity: a term is
a word, an entity the exact value of a base span, and both meet in every text that holds them, however far apart. Over the
distinct texts of the corpus, df(t), df(e) and df(t, e) count texts with the term, with the entity and with both. The term's disclosure of the entity is its pointwise mutual information over the entity's information,
log(N df(t,e) / (df(t) df(e))) / log(N / df(e)): 1 where the term only stands in texts with the entity, 0 where it tells nothing.
Pairs seen in fewer than SUPPORT distinct texts estimate nothing and disclose nothing. A term whose disclosure reaches
THRESHOLD is marked at all its places in all texts, as it gives the entity away wherever it is read. Words are read outside
base spans, which are generalised anyway. In the cleaned text base spans are generalised to their kind and disclosing terms
are removed.

The patterns are written so that Java's matcher neither backtracks nor recurses on long runs; where the plain form would
try every start in a run of the same characters, a look-behind lets only the run's start (or the end of the match before)
begin one, which is where the leftmost match begins anyway.

Defined cases: a null text is empty and has no spans; identical texts count once in the corpus and each gets its spans;
null or repeated doc_ids are kept row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
SIGNS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
#: Texts that must show a pair, share of the entity's information.
SUPPORT, THRESHOLD = 3, 0.9
TERM = r"[\p{L}][\p{L}\p{M}'’-]*"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a run of digits passes the Luhn test: every second digit from the right doubled, its own digits summed."""
    twice = "0246813579"
    value = lambda d, i: F.when(i % 2 == 1, F.substring(F.lit(twice), d + 1, F.lit(1)).cast("int")).otherwise(d)
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(F.when(c == "", "0").otherwise(c).cast("int"), i)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    digits = _digits(found)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.length(digits).between(16, 19) & _luhn(digits)


def matches(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """All matches of a pattern, or those wanted: array<struct<start, end, found>>, code points, end exclusive.

    What lies between matches comes from splitting at them, so running lengths give the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["found"])
        more = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found"))))
        return F.struct(end.alias("at"), (more if wanted is None else F.when(wanted(x["found"]), more).otherwise(acc["out"])).alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _of_kind(kind: str) -> Column:
    kept = F.filter(matches(F.col("text"), PATTERNS[kind]), lambda x: _valid(kind, x["found"]))
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))


def with_base(docs: DataFrame) -> DataFrame:
    """docs (text not null) with base: array<struct<kind, start, end, found>> by kind as listed, then start."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
    for kind in KINDS:
        spans = _of_kind(kind)
        docs = docs.withColumn(f"_{kind}", F.when(F.col("text").rlike(SIGNS[kind]), spans).otherwise(empty))
    return docs.withColumn("base", F.concat(*[F.col(f"_{k}") for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def blanked(text: Column, base: Column) -> Column:
    """text with white space in place of its base spans, every other character where it was."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.repeat(F.lit(" "), x["end"] - F.greatest(x["start"], acc["at"])))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    order = F.sort_array(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.when(F.size(base) > 0, F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text)


def _words(text: Column, base: Column) -> Column:
    """The distinct words outside base spans."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(blanked(text, base), F.lit(TERM), F.lit(0))), F.lower))


def _places(text: Column, base: Column, told: Column) -> Column:
    """array<struct<kind, start, end, found>>: all places of the terms told, by start; none where told is null."""
    found = matches(blanked(text, base), TERM, lambda w: F.array_contains(told, F.lower(w)))
    spans = F.transform(found, lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["found"]).alias("found")))
    return F.when(told.isNotNull(), spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>"))


def _keyed(docs: DataFrame) -> DataFrame:
    """text (null: empty) and its key, beside the columns asked for."""
    return docs.withColumn("text", common.text_of()).withColumn("key", F.md5("text"))


def disclosing(texts: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """entity, term of the pairs whose disclosure reaches the threshold. texts: key, entities, words, both distinct; one row a distinct text.

    A pair is counted only if it could reach the threshold were it in all the texts that its rarer side is in: that takes
    df(t) <= N (df(e) / N) ** threshold, and SUPPORT texts of either.
    """
    total = float(texts.count())
    told = texts.select("key", F.explode("entities").alias("entity"))
    entities = told.groupBy("entity").agg(F.count("*").alias("df_entity")).filter((F.col("df_entity") >= support) & (F.col("df_entity") < total))
    entities = common.stored(entities, "pii-entities")
    most = entities.agg(F.max("df_entity")).first()[0] or 0
    bound = lambda df: F.lit(total) * F.pow(df / F.lit(max(total, 1.0)), F.lit(threshold)) * (1 + 1e-9)
    terms = texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    terms = common.stored(terms.filter((F.col("df_term") >= support) & (F.col("df_term") <= bound(F.lit(float(most))))), "pii-terms")
    holders = common.stored(told.join(entities, "entity"), "pii-holders")
    words = texts.join(holders.select("key").distinct(), "key", "left_semi").select("key", F.explode("words").alias("term")).join(terms, "term")
    met = words.join(holders, "key").filter(F.col("df_term") <= bound(F.col("df_entity")))
    pairs = met.groupBy("entity", "term", "df_entity", "df_term").agg(F.count("*").alias("both")).filter(F.col("both") >= support)
    own = F.log(F.lit(total) / F.col("df_entity"))
    gain = F.log(F.lit(total) * F.col("both") / (F.col("df_term") * F.col("df_entity")))
    return pairs.filter(gain >= F.lit(threshold) * own).select("entity", "term")


def told_terms(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """key, told: array<string>: the disclosing terms of the texts that hold any, with their entity or without."""
    entities = F.array_distinct(F.transform("base", lambda e: F.concat(e["kind"], F.lit(":"), e["found"])))
    texts = with_base(_keyed(docs.select("text"))).select("key", entities.alias("entities"), _words(F.col("text"), F.col("base")).alias("words"))
    texts = common.stored(texts.dropDuplicates(["key"]), "pii-texts")
    found = common.stored(disclosing(texts, threshold, support).select("term").distinct(), "pii-disclosing")
    held = texts.select("key", F.explode("words").alias("term")).join(found, "term")
    return common.stored(held.groupBy("key").agg(F.collect_list("term").alias("told")), "pii-told")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def spans(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id, base, terms: the spans of every document."""
    rows = with_base(_keyed(docs.select("doc_id", "text"))).join(told_terms(docs, threshold, support), "key", "left")
    return rows.select("doc_id", "base", _places(F.col("text"), F.col("base"), F.col("told")).alias("terms"))


def cleaned(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """docs with all their columns; in text, base spans are generalised to [KIND] and disclosing terms removed. Texts without spans, null among them, stay as they are."""
    names = docs.columns
    rows = docs.select("text", *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(names) if c != "text"])
    rows = with_base(rows.withColumn("key", F.md5(common.text_of()))).join(told_terms(docs, threshold, support), "key", "left")
    rows = rows.withColumn("terms", _places(F.col("text"), F.col("base"), F.col("told")))
    every = F.sort_array(F.transform(F.concat("base", "terms"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        put = F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        new = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), put)
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    text = F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    new = F.when(F.size(every) > 0, text).otherwise(F.col("text"))
    return rows.select(*[new.alias(c) if c == "text" else F.col(f"_{k}").alias(c) for k, c in enumerate(names)])


def op7_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(common.table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(number, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "terms")).alias("spans"), F.size("base").cast("long").alias("n_base"), F.size("terms").cast("long").alias("n_terms"), (F.size("base") + F.size("terms")).cast("long").alias("n_spans"))
