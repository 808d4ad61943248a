"""Ranked substring search over blocks, by scan or by the trigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import occurrences, trigrams_of

DEFAULT_LIMIT, MOST_LIMIT, CLUES_LIMIT = 50, 100, 15


def rank(blocks: DataFrame, query: str) -> DataFrame:
    """Blocks that hold the query, with how often."""
    low = F.lower(F.lit(query))
    return blocks.filter(F.contains(F.lower("text"), low)).withColumn("occurrences", occurrences(F.col("text"), query)).filter("occurrences > 0")


def top(hits: DataFrame, limit: int) -> DataFrame:
    """Most occurrences first, then shorter blocks, then lower ids."""
    return hits.orderBy(F.desc("occurrences"), F.octet_length("text"), "block_id").limit(limit)


def candidates(postings: DataFrame, query: str) -> DataFrame:
    """Rows of the query's trigrams; the IN list is pushed to the scan."""
    return postings.filter(F.col("trigram").isin(trigrams_of(query)))


def intersect(postings: DataFrame, query: str) -> DataFrame:
    """Blocks that have all trigrams of the query: division by counting, as a posting is
    a distinct pair."""
    grams = trigrams_of(query)
    return candidates(postings, query).groupBy("block_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("block_id")


def search(blocks: DataFrame, query: str, limit: int = DEFAULT_LIMIT, postings: DataFrame | None = None) -> DataFrame:
    """The best blocks for a query.

    With an index and a query of three bytes or more, blocks are first narrowed to those
    with all its trigrams; verification follows, so both ways give the same rows.  Nothing
    matches an empty query."""
    if not query:
        return top(rank(blocks, "x").filter(F.lit(False)), limit)
    if postings is not None and len(query.lower().encode()) >= 3:
        blocks = blocks.join(intersect(postings, query), "block_id", "left_semi")
    return top(rank(blocks, query), limit)


def search_many(blocks: DataFrame, queries: list[str], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Top blocks of each query in one pass over the blocks: every block meets the literal
    list of queries inside its row, and only hits are ranked."""
    pairs = F.filter(
        F.transform(F.array(*[F.lit(q) for q in queries]), lambda q: F.struct(q.alias("query"), F.lower(q).alias("low"))),
        lambda s: F.contains(F.lower(F.col("text")), s["low"]),
    )
    hits = blocks.withColumn("s", F.explode(pairs))
    low = F.lower("text")
    n = ((F.char_length(low) - F.char_length(F.replace(low, F.col("s.low"), F.lit("")))) / F.char_length("s.low")).cast("long")
    hits = hits.select(F.col("s.query").alias("query"), *blocks.columns, n.alias("occurrences"))
    order = Window.partitionBy("query").orderBy(F.desc("occurrences"), F.octet_length("text"), "block_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def matching_lines(hits: DataFrame, query: str, most: int = 6) -> DataFrame:
    """The first `most` lines of each hit that hold the query, with their numbers in the
    file, and whether there are more."""
    low = F.lower(F.lit(query))
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((F.col("line") + i).alias("line_no"), x.alias("matched")))
    found = hits.withColumn("_m", F.filter(every, lambda s: F.contains(F.lower(s["matched"]), low)))
    shown = found.withColumn("more", F.size("_m") > most).withColumn("_m", F.slice("_m", 1, most))
    return shown.select("block_id", "more", F.inline("_m"))


def match_ranges(line: str, query: str) -> list[tuple[int, int]]:
    """Byte ranges of the original line whose lower-cased form holds the query, also where
    lower-casing changes a character's length; touching ranges are one."""
    low, need = line.lower(), query.lower()
    if not need:
        return []
    origin: list[int] = []
    for i, ch in enumerate(line):
        origin += [i] * len(ch.lower())
    if len(origin) != len(low):  # context-dependent forms keep their length
        low = "".join(ch.lower() for ch in line)
    offset = [0]
    for ch in line:
        offset.append(offset[-1] + len(ch.encode()))
    out: list[tuple[int, int]] = []
    at = low.find(need)
    while at >= 0:
        a, b = offset[origin[at]], offset[origin[at + len(need) - 1] + 1]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
        at = low.find(need, at + len(need))
    return out
