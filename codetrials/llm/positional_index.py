"""Benchmark decontamination over a positional inverted index, in DataFrame functions alone.

1. Every token of the training texts is counted if a test phrase has it.
2. A phrase is looked up by its ``ANCHORS`` rarest terms; a phrase with a term that no text has is out.
3. The postings (term, text, position) of these terms are stored as a table in the shared folder.
4. Each phrase starts from the list of its rarest term, shifted by the term's offset to where the phrase would begin; the
   lists of its other anchors, shifted likewise, are intersected one by one.  With a ``slop``, positions that far from
   their place still meet, which gives proximity matches.
5. What is left is checked word by word in the text itself.

Every join is on equal keys, one of them a term; a term that a third of the postings have is split by the adaptive skew
join, since the phrases are the small side.  Nothing is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.llm.names import unused
from codetrials.plans.scratch import scratch_path

WINDOW = 13
ANCHORS = 3
#: What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1)
    return F.filter(parts, lambda w: w != "")


def phrases_of(items: DataFrame, window: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(terms, items): each different window of ``window`` words with the items that have it; a shorter item, but not an
    empty one, is one window."""
    words = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return (
        words.select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at"), window).alias("terms"))
        .groupBy("terms")
        .agg(F.collect_set("item").alias("items"))
        .select(F.xxhash64("terms").alias("phrase"), "terms", "items")
    )


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of one id and one text are alike in every result, so both together name them."""
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text")
    )


def tokens_of(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "text_key", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))


def anchored(phrases: DataFrame, texts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """Phrases with ``anchor_1``, ``anchor_2`` ...: their rarest terms in the texts, each with its offset, null beyond the
    phrase's length."""
    terms = phrases.select("phrase", F.posexplode("terms").alias("offset", "term"))
    tokens = texts.select(F.explode(words_of(F.col("text"))).alias("term"))
    counts = tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    ranked = (
        terms.join(counts, "term")
        .groupBy("phrase")
        .agg(F.count("*").alias("found"), F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("ranked"))
    )
    return (
        phrases.join(ranked, "phrase")
        .where(F.col("found") == F.size("terms"))
        .select("phrase", "terms", "items", *[F.get("ranked", F.lit(k)).alias(f"anchor_{k + 1}") for k in range(anchors)])
    )


def postings_of(texts: DataFrame, phrases: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """The stored index: (term, doc_id, text_key, pos) of every token that anchors a phrase."""
    spark = texts.sparkSession
    wanted = phrases.select(F.explode(F.array(*[f"anchor_{k + 1}.term" for k in range(anchors)])).alias("term"))
    path = scratch_path(spark, "postings")
    tokens_of(texts).join(wanted.where("term is not null").distinct(), "term", "left_semi").write.parquet(path)
    return spark.read.schema("term string, doc_id long, text_key long, pos int").parquet(path)


def intersected(postings: DataFrame, phrases: DataFrame, anchors: int = ANCHORS, slop: int = 0) -> DataFrame:
    """(doc_id, text_key, start, phrase): where all anchors of a phrase stand at their offsets, up to ``slop`` words off."""
    found = postings.join(
        phrases.select("phrase", *[f"anchor_{k + 1}" for k in range(anchors)]),
        F.col("term") == F.col("anchor_1.term"),
    ).select("doc_id", "text_key", (F.col("pos") - F.col("anchor_1.offset")).alias("start"), "phrase", *[f"anchor_{k + 1}" for k in range(1, anchors)])
    if not slop:
        found = found.where("start >= 0")
    for k in range(1, anchors):
        anchor = f"anchor_{k + 1}"
        there = postings.select(
            F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("term").alias("other"), F.col("pos").alias("p")
        )
        place = F.col("start") + F.col(f"{anchor}.offset")
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col(f"{anchor}.term") == F.col("other"))
        if slop:
            wide = slop + 1  # a position off by at most slop is in this bucket or next to it
            there = there.withColumn("near", F.explode(F.array(*[F.floor(F.col("p") / wide) + j for j in (-1, 0, 1)])))
            same &= (F.floor(place / wide) == F.col("near")) & (F.abs(F.col("p") - place) <= slop)
        else:
            same &= place == F.col("p")
        open_ = found.where(F.col(anchor).isNotNull())
        found = open_.join(there, same, "left_semi").unionByName(found.where(F.col(anchor).isNull()))
    return found.select("doc_id", "text_key", "start", "phrase")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, text, hits): each document with its verified matches, an array of (start, length, items, exact).

    ``exact``: the words of the phrase stand there one after the other.  With ``slop``, a match that is not exact has all
    its terms among the words from ``slop`` before to ``slop`` after the place; with 0 there are exact ones only.
    """
    texts = keyed(docs, key, text)
    spark = docs.sparkSession
    path = scratch_path(spark, "phrases")
    anchored(phrases_of(items, window), texts).write.parquet(path)  # read three times from here on
    phrases = spark.read.parquet(path)
    places = intersected(postings_of(texts, phrases), phrases, slop=slop)
    of_text = (
        places.join(phrases.select("phrase", "terms", "items"), "phrase")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "terms", "items")).alias("places"))
        .select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "places")
    )
    joined = texts.join(of_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    words = F.col("words")

    def seen(p):
        exact = (p.start >= 0) & (F.slice(words, F.greatest(p.start, F.lit(0)) + 1, F.size(p.terms)) == p.terms)
        return F.struct(p.start.alias("start"), F.size(p.terms).alias("length"), p["items"].alias("items"), exact.alias("exact"), p.terms.alias("terms"))

    def close(p):
        low = F.greatest(p.start - slop, F.lit(0))
        around = F.slice(words, low + 1, p.start + p.length + slop - low)
        return p.exact | (F.size(F.array_except(p.terms, around)) == 0)

    checked = joined.withColumn("words", F.when(F.col("places").isNotNull(), words_of(F.col("text"))))
    checked = checked.withColumn("hits", F.transform("places", seen))
    kept = F.filter("hits", close if slop else (lambda p: p.exact))
    return checked.select("doc_id", "text_key", "text", kept.alias("hits"))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: its words, those inside an occurrence of a test window, the number and hash of the items
    with occurring windows, and whether at least one word of ``share`` is hit.

    A null or wordless text has no words and is clean, a null or wordless item has no window.  Rows of one id are judged
    each by its own text.  Empty tables give an empty result, or all documents clean.
    """
    return judged(docs, items, window, share, key, text).drop("text_key")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns they came with, whatever their names."""
    name = unused(docs, "contaminated")
    bad = judged(docs, items, key=key, text=text).where("contaminated")
    bad = bad.select(F.struct(F.col(key).alias("id"), F.col("text_key").alias("text")).alias(name))
    own = F.struct(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return docs.join(bad, own.eqNullSafe(F.col(name)), "left_anti")


def judged(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The result of ``decontaminate`` with ``text_key``, which tells rows of one id apart."""
    found = matches(docs, items, window, key=key, text=text)
    spans = F.flatten(F.transform("hits", lambda p: F.sequence(p.start, p.start + p.length - 1)))
    n_hit = F.coalesce(F.size(F.array_distinct(spans)), F.lit(0))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda p: p["items"]))))
    counted = found.select(
        F.col("doc_id").alias(key),
        "text_key",
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.when(F.col("hits").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"),
        F.coalesce(names, F.array().cast("array<string>")).alias("names"),
    )
    return counted.select(
        key,
        "text_key",
        "n_words",
        "n_hit",
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
