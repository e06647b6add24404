"""Language identification by bit-sliced Bloom filters of n-grams.

One table of machine words holds the Bloom filters of all languages side by side: bit l of a word belongs to language l,
so one look-up per hash, and-ed, returns every language that contains the n-gram.  A text's hits are counted per
language, each count is corrected for the false positives that the filter's filling makes likely, and the largest share
decides.  Fitting reads a bounded sample of labelled rows (``per_language`` rows of each language or about as many);
everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetrials.llm import blocks as B

PER_LANGUAGE = 4000  # rows of the sample
MOST_LANGUAGES = 1024  # 32 MB of filters
GRAMS = 20_000  # the most frequent n-grams of a language
SHARE = 0.5  # an n-gram belongs to a language if it is at least this frequent there, against where it is most frequent
SLOTS = 1 << 18
HASHES = 3
WIDTH = 4
UNKNOWN = "und"
TO_JUDGE = 8  # n-grams that a text needs before its score can speak against it
COUNTS = "lang string, gram long, n long"
RESULT = "doc_id long, lang_pred string, score double"

# ASCII letters are lower-cased, other ASCII is a blank, the rest stands for itself
BLANK = np.uint8(0x20)
PLAIN = B.LOWER.copy()
PLAIN[:0x80] = np.where((PLAIN[:0x80] >= 0x61) & (PLAIN[:0x80] <= 0x7A), PLAIN[:0x80], BLANK)


@dataclass
class Filters:
    languages: list[str]
    words: np.ndarray  # slots x planes of 64 languages
    false_rate: np.ndarray  # per language

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as bits."""
        at = slots_of(grams)
        out = self.words[at[0]]
        for k in at[1:]:
            out = out & self.words[k]
        return out


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    """The places of an n-gram, a few bits of one hash for each."""
    h = B.mixed(grams.astype(np.uint64) + B.ODD)
    bits = np.uint64(SLOTS.bit_length() - 1)
    return [((h >> (bits * np.uint64(k))) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def grams_of(block: B.Block):
    """(n-grams, their texts): four bytes of blank-padded text with at most one blank among them."""
    data = np.concatenate([[BLANK], PLAIN[block.data]])  # every text now has a blank before and after it
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    gram = np.zeros(n, dtype=np.uint32)
    blanks = np.zeros(n, dtype=np.uint8)
    for j in range(WIDTH):
        gram |= data[j : j + n].astype(np.uint32) << np.uint32(8 * j)
        blanks += data[j : j + n] == BLANK
    # a gram over a text's end holds the line feed between two texts as a blank; only its first or last byte may be it
    size = np.maximum(block.lens, 0)
    inside = np.ones(n, dtype=bool)
    for j in range(1, WIDTH - 1):
        crossing = block.ends + 1 - j
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    good = np.flatnonzero((blanks <= 1) & inside)
    ends = np.cumsum(size + 1)
    return gram[good], np.searchsorted(ends, good + 1, side="right")


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters from the rows with a text and a language; sampled, by a hash of the id, to ``per_language`` of each.

    More than ``MOST_LANGUAGES`` different languages raise: filters, their table and a condition grow with them.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    many = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}  # a row for each language
    if len(many) > MOST_LANGUAGES:
        raise ValueError(f"column {lang!r} holds more than {MOST_LANGUAGES} languages")
    languages = sorted(many)
    sampled = None
    for name in languages:
        keep = round(min(1.0, per_language / many[name]) * (1 << 20))
        of = (F.col(lang) == name) & (F.pmod(F.xxhash64(F.col(key), F.lit("langid")), F.lit(1 << 20)) < keep)
        sampled = of if sampled is None else sampled | of
    if sampled is None:
        return Filters([], np.zeros((SLOTS, 1), dtype=np.uint64), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            for name in np.unique(names):
                only = batch.filter(pa.array(names == name)).select([1, 2])
                for block in B.in_chunks(iter([only])):
                    gram, n = np.unique(grams_of(block)[0], return_counts=True)
                    if len(gram):
                        columns = [pa.array([str(name)] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)]
                        yield pa.RecordBatch.from_arrays(columns, schema=B.arrow_schema(COUNTS))

    slim = rows.where(sampled).select(lang, F.col(key).cast("long"), F.col(text).cast("binary"))
    counts = slim.mapInArrow(count, COUNTS).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(total, "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    chosen = (
        rates.join(most, "gram")
        .where(F.col("rate") >= SHARE * F.col("most"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= GRAMS)
        .select("lang", "gram")
        .toArrow()  # at most GRAMS rows a language
    )
    words = np.zeros((SLOTS, -(-len(languages) // 64)), dtype=np.uint64)
    number = {name: k for k, name in enumerate(languages)}
    owner = np.array([number[x] for x in chosen.column("lang").to_pylist()], dtype=np.int64)
    gram = chosen.column("gram").to_numpy()
    for at in slots_of(gram):
        np.bitwise_or.at(words, (at, owner // 64), np.uint64(1) << (owner % 64).astype(np.uint64))
    filling = [((words[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
    return Filters(languages, words, np.array(filling) ** HASHES)


def shares(block: B.Block, filters: Filters) -> np.ndarray:
    """Per text and language: the corrected share of its n-grams that the language contains; -1 without n-grams."""
    gram, doc = grams_of(block)
    many = np.bincount(doc, minlength=len(block.ids)).astype(np.float64)
    out = np.full((len(block.ids), len(filters.languages)), -1.0)
    masks = filters.masks(gram)
    for k in range(len(filters.languages)):
        hit = ((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)
        hits = np.bincount(doc[hit], minlength=len(block.ids))
        with np.errstate(invalid="ignore", divide="ignore"):
            share = (hits / many - filters.false_rate[k]) / (1 - filters.false_rate[k])
        out[:, k] = np.where(many > 0, share, -1)
    return out


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score in 0..1) of every row.

    ``und`` and 0 for a null text, a text without a letter, or filters without a language.  A text too short for an
    n-gram is given the first language, with score 0.  Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words a plane, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.in_chunks(batches):
            rows = zip(block.ids.tolist(), judged(block, shared.value), strict=True)
            yield from B.packed([(B.real_id(i), *found) for i, found in rows], RESULT)

    return B.as_bytes(docs, key, text).mapInArrow(run, RESULT)


def judged(block: B.Block, filters: Filters) -> list[tuple[str, float]]:
    share = shares(block, filters)
    raw = block.raw()
    letters = np.append(0, np.cumsum((PLAIN[block.data] >= 0x61) & (PLAIN[block.data] <= 0x7A)))
    has_ascii = letters[block.ends] - letters[block.begins] > 0
    out = []
    for k, (a, z) in enumerate(zip(block.begins.tolist(), block.ends.tolist(), strict=True)):
        if not filters.languages or not (has_ascii[k] or any(c.isalpha() for c in raw[a:z].decode())):
            out.append((UNKNOWN, 0.0))
        else:
            best = int(share[k].argmax())
            out.append((filters.languages[best], float(min(1.0, max(0.0, share[k][best])))))
    return out


def worth_keeping(block: B.Block, filters: Filters, least: float) -> list[bool]:
    """Which texts have a language, or a letter and nothing that speaks against one."""
    raw = block.raw()
    many = np.bincount(grams_of(block)[1], minlength=len(block.ids))
    out = []
    for k, (name, score) in enumerate(judged(block, filters)):
        if name != UNKNOWN and score >= least:
            out.append(True)
        else:
            judge = bool(filters.languages) and many[k] >= TO_JUDGE
            out.append(not judge and any(c.isalpha() for c in raw[block.begins[k] : block.ends[k]].decode()))
    return out


def accepted(docs: DataFrame, filters: Filters, least: float = 0.1, text: str = "text") -> DataFrame:
    """The rows with a language; all columns stay as they are.

    A text without a letter (or a null one) has none.  A text with letters goes only if it was judged, by filters of at
    least one language and ``TO_JUDGE`` n-grams of its own, and scored below ``least``: it is hardly like any language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            ids = pa.array(np.arange(batch.num_rows))
            slim = pa.RecordBatch.from_arrays([ids, texts], names=["id", "t"])
            keep = [k for block in B.in_chunks(iter([slim])) for k in worth_keeping(block, shared.value, least)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(key: str = "doc_id") -> Column:
    """A third of the ids, by their CRC; a null id is in training."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, predict all of them."""
    filters = fit(docs.where(~is_held_out(key)), key=key, text=text, lang=lang)
    found = predict(docs, filters, key, text)
    return found.select(F.col("doc_id").alias(key), is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
