"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight and a schedule: its rate of use rises or falls linearly over the
run.  The integral of the schedule says which share of the source's words is due by each
moment; inverting it turns a document's place in the cumulative demand of its source into
a training position from 0 to 1, and documents are range-sorted by position.

A source's stream repeats its documents, in an order of md5(doc_id), as often as its
target asks for.  Running sums are taken in two levels (source and md5 prefix, then inside
one prefix), so a hot source is spread over 4096 small groups instead of one task.

Defined results: null or blank texts have size 0 and take nothing; null sources form one
source that sorts last; rows with equal doc_id and text are each mixed on their own (ties
in the order are broken by text and all leave the same totals); an empty table gives an
empty result.  The added columns replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text import WORD

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
SLOPE = 0.8
PREFIX = 3


def word_count(text: Column) -> Column:
    """How many words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target, slope of each source, from rows of (source, size).

    Filling in order of the cap per weight gives the level at which the rest share alike.
    The windows hold one row per source, after a combined aggregation."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % n + 1).cast("int"))
    per = per.withColumn("at", at).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "at")
    everything = Window.partitionBy()
    per = (
        per.withColumn("full_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (budget * F.sum("source_size").over(everything) - F.col("full_before")) / F.col("w_from"))
    )
    # The first source in this order that isn't full sets the level of all that follow.
    first = F.min(F.when(F.col("w") * F.col("level") < F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "at", "level"))).over(everything)
    per = per.withColumn("open", first)
    full = F.col("open").isNull() | (F.struct((F.col("cap") / F.col("w")).alias("r"), "at") < F.struct("open.r", "open.at"))
    return per.select(
        "source",
        "source_size",
        F.when(full, F.col("cap")).otherwise(F.col("w") * F.col("open.level")).alias("target"),
        F.when(F.col("at") % 2 == 0, F.lit(SLOPE)).otherwise(F.lit(-SLOPE)).alias("slope"),
    )


def position(share: Column, slope: Column) -> Column:
    """The moment x at which (1 - slope) * x + slope * x^2, the integral of a linear
    schedule, reaches the share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def assign(docs: DataFrame, **settings) -> DataFrame:
    """docs with size, source_size, target, taken and positions, one for each copy taken."""
    base = (
        docs.withColumn("size", word_count(F.col("text")))
        .withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("_prefix", F.substring("_order", 1, PREFIX))
        .withColumn("_tie", F.xxhash64("text"))
    )
    sized = docs.select("source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).substr(1, PREFIX).alias("_prefix"))
    cells = sized.groupBy("source", "_prefix").agg(F.sum("size").alias("size"))
    goal = targets(cells.select("source", "size"), **settings)
    before = F.sum("size").over(Window.partitionBy("source").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    starts = cells.withColumn("_before", before).drop("size")
    starts = starts.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "c._prefix", "c._before", "g.source_size", "g.target", "g.slope")
    starts = starts.select(F.col("source").alias("_s"), F.col("_prefix").alias("_p"), "_before", "source_size", "target", F.col("slope").alias("_slope"))
    clash = [c for c in ("source_size", "target", "taken", "positions") if c in docs.columns]
    joined = base.drop(*clash).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_prefix") == F.col("_p")))
    inner = Window.partitionBy("source", "_prefix").orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_before") + F.sum("size").over(inner) - F.col("size") / 2
    joined = joined.withColumn("_middle", middle)
    most = settings.get("most", MOST)
    copies = F.array(*[F.when((F.col("size") > 0) & (F.col("_middle") + k * F.col("source_size") <= F.col("target")), (F.col("_middle") + k * F.col("source_size")) / F.col("target")) for k in range(most)])
    joined = joined.withColumn("positions", F.transform(F.filter(copies, lambda s: s.isNotNull()), lambda s: position(s, F.col("_slope"))))
    return joined.withColumn("taken", F.size("positions") * F.col("size")).drop("_order", "_prefix", "_tie", "_s", "_p", "_before", "_slope", "_middle")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row for each copy that the mix takes, with its position, range-sorted by it."""
    taken = assign(docs, **settings)
    return taken.select("*", F.explode("positions").alias("position")).drop("positions").orderBy("position", "doc_id")
