"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over cells of source, language and topic.  Raking scales the cells to the target total of each source,
then of each language, then of each topic, and again, until all totals are within a tolerance of their targets; a cell
never gets more than the tokens it has.  A document is then kept with its cell's probability, the calibrated tokens over the tokens there are, by a hash of
its id: the same documents whatever the number of tasks.

A cell is a combination of categories and not a document.  The targets are put on the cells once; a sweep is three small
aggregates and one write to the shared folder, which cuts the lineage and brings the deviations along.
"""

from __future__ import annotations

import warnings
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codetrials.llm.names import unused
from codetrials.plans.scratch import scratch_path

DIMENSIONS = ("source", "lang", "topic")
POWER = 0.7  # target shares are in proportion to this power of the tokens
BUDGET = 0.5  # of all tokens
SWEEPS, TOLERANCE = 20, 5e-3
NONE = "(none)"
CELLS = "source string, lang string, topic string, tokens double, goal double"


BLANKS = " \t\n\x0b\f\r"


def tokens_of(text: Column) -> Column:
    """Words between blanks; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the text alone: legal notices, symbols, figures, or prose by its length."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    marks = size - F.length(F.translate(text, "$%#*&!=<>{}[]()@|~^+", ""))
    digits = size - F.length(F.translate(text, "0123456789", ""))
    return (
        F.when(F.lower(text).contains("license"), "legal")
        .when(marks * 20 > size, "symbols")
        .when(digits * 20 > size, "figures")
        .when(size < 1000, "brief")
        .when(size < 8000, "article")
        .otherwise("long")
    )


def described(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens); a null category is one of its own."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return docs.select(
        key, of("source"), of("lang"), (topic_of(F.col(text)) if topic is None else topic).alias("topic"), tokens_of(F.col(text)).alias("tokens")
    )


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def all_targets(
    cells: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, power: float = POWER, budget: float = BUDGET
) -> DataFrame:
    """(dimension, category, target): in each dimension, shares in proportion to a power of the tokens, of ``budget`` of
    all of them.

    No category gets more tokens than it has; what it cannot take goes to the others in the same proportion, so the
    targets of every dimension have the same sum.  All dimensions are settled together, round by round.
    """
    of = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in dimensions]))
    own = cells.select(of.alias("of"), "tokens").groupBy("of.dimension", "of.category").agg(F.sum("tokens").alias("tokens"))
    own = written(own.withColumn("weight", F.pow("tokens", F.lit(power))), "categories")
    sums = {r[0]: r[1:] for r in own.groupBy("dimension").agg(F.sum("tokens"), F.sum("weight")).collect()}  # a row a dimension
    wanted = {d: tokens * min(budget, 1.0) for d, (tokens, _) in sums.items()}
    level = {d: wanted[d] / (weight or 1.0) for d, (_, weight) in sums.items()}
    full = dict.fromkeys(level, 0)

    def at(levels: dict[str, float]) -> Column:
        return reduce(lambda c, d: c.when(F.col("dimension") == d, F.lit(levels[d])), levels, F.when(F.lit(False), F.lit(0.0)))

    while level:  # each round fills at least one category more, mostly many
        filled = F.col("weight") * at(level) >= F.col("tokens")
        held = own.groupBy("dimension").agg(
            F.count_if(filled), F.sum(F.when(filled, F.col("tokens"))), F.sum(F.when(~filled, F.col("weight")))
        )
        settled = True
        for d, n, taken, open_ in held.collect():  # a row a dimension
            if n > full[d] and open_:
                level[d], full[d], settled = (wanted[d] - taken) / open_, n, False
        if settled:
            break
    return own.select("dimension", "category", F.least(F.col("weight") * at(level), F.col("tokens")).alias("target"))


def targets(cells: DataFrame, dimension: str, power: float = POWER, budget: float = BUDGET) -> DataFrame:
    """(category, target tokens) of one dimension, by :func:`all_targets`."""
    return all_targets(cells, (dimension,), power, budget).select(F.col("category").alias(dimension), "target")


def with_targets(cells: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """The cells with a column ``target_<dimension>`` for each of ``wanted``, null where a category has none."""
    for d, target in wanted.items():
        cells = cells.join(target.select(d, F.col("target").alias(f"target_{d}")), d, "left")
    return cells


def raked(
    cells: DataFrame, wanted: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE
) -> DataFrame:
    """Cells with ``goal``, the tokens to take of each, fitted to the targets of each dimension.

    ``wanted``: for each dimension (category, target).  A category without a target keeps its tokens.  Fitting ends when a
    sweep finds every total so near its target that none is further off than ``tolerance`` after it.  Targets that cannot
    be met together, since a cell has no more tokens, are approached; after ``sweeps`` a warning says how far each
    dimension was from its targets.
    """
    kept = [*cells.columns]
    now = written(with_targets(cells, wanted).withColumn("goal", F.col("tokens")), "cells")
    off: dict[str, float] = {}
    for k in range(sweeps):
        seen = []
        for d in wanted:
            total, target = F.sum("goal"), F.max(f"target_{d}")
            miss = F.when(target > 0, F.abs(total - target) / target).otherwise((total > 0).cast("double"))
            sums = now.groupBy(d).agg((target / F.when(total > 0, total)).alias("factor"), miss.alias(f"off_{d}"))
            goal = F.least(F.col("goal") * F.coalesce("factor", F.lit(1.0)), F.col("tokens"))
            now = now.join(sums, d, "left").withColumn("goal", goal).drop("factor")
            seen.append(F.coalesce(F.max(F.when(F.col(f"target_{d}").isNotNull(), F.col(f"off_{d}"))), F.lit(0.0)).alias(d))
        observed = Observation(f"sweep-{k}")
        now = now.observe(observed, *seen).drop(*[f"off_{d}" for d in wanted]) if seen else now
        now = written(now, f"sweep-{k}")
        off = observed.get if seen else {}
        # what a sweep moves a total by, after its own turn, is at most the product of the other dimensions' steps
        if prod(1 + x for x in off.values()) - 1 <= tolerance:
            return now.select(*kept, "goal")
    far = ", ".join(f"{d} {x:.2%}" for d, x in sorted(off.items()))
    warnings.warn(f"raking ends after {sweeps} sweeps with totals off their targets by up to: {far}", RuntimeWarning, stacklevel=2)
    return now.select(*kept, "goal")


def uniform(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(1 << 53)) / F.lit(float(1 << 53))


def of_cells(described: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, goal, probability) of each cell of :func:`described` documents."""
    parts = described.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens"))
    cells = written(parts.where("tokens > 0"), "tokens")
    goals = written(all_targets(cells), "targets")
    wanted = {d: goals.where(F.col("dimension") == d).select(F.col("category").alias(d), "target") for d in DIMENSIONS}
    return raked(cells, wanted).withColumn("probability", F.col("goal") / F.col("tokens"))


def probabilities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(source, lang, topic, tokens, goal, probability) of each cell."""
    return of_cells(described(docs, key, text))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled documents: id, cell, tokens, probability and weight (its inverse).

    A document without tokens is never taken.  Rows of one id are taken or left together if they are of one cell.  An
    empty table gives an empty result.  The texts are read once.
    """
    slim = written(described(docs, key, text).where("tokens > 0"), "described")
    cells = of_cells(slim).select(*DIMENSIONS, "probability")
    return (
        slim.join(cells, list(DIMENSIONS))
        .where(uniform(key) < F.col("probability"))
        .select(key, *DIMENSIONS, F.col("tokens").alias("n_tokens"), "probability", (1 / F.col("probability")).alias("weight"))
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled documents with the columns they came with, whatever their names."""
    own = lambda d: F.coalesce(F.col(d).cast("string"), F.lit(NONE))
    cell, chance = unused(docs, "cell"), unused(docs, "probability")
    cells = probabilities(docs, key, text).select(F.struct(*DIMENSIONS).alias(cell), F.col("probability").alias(chance))
    of = F.struct(own("source").alias("source"), own("lang").alias("lang"), topic_of(F.col(text)).alias("topic"))
    filled = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS)) != ""
    taken = docs.where(filled).join(cells, of == F.col(cell)).where(uniform(key) < F.col(chance))
    return taken.select(*[docs[c] for c in docs.columns])
