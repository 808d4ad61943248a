"""Files to blocks, and blocks to postings.

A block is a run of non-blank lines, of at most MOST_LINES lines.  Everything happens
inside one row, so chunking a corpus needs no shuffle whatever the sizes of its files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import BLANK, bind, fnv64_bulk, lines, trigrams

MOST_LINES = 80
#: A file of 5 MiB has fewer blocks than these bits can number.
SEQUENCE_BITS = 21


def _starts(ls: Column) -> Column:
    """Indexes of lines at which a block begins."""
    filled = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: ~ls[i].rlike(BLANK))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(-2).alias("last"), F.lit(0).alias("n"))

    def step(s: Column, i: Column) -> Column:
        goes_on = (i == s["last"] + 1) & (s["n"] < MOST_LINES)
        return F.struct(
            F.when(goes_on, s["at"]).otherwise(F.concat(s["at"], F.array(i))).alias("at"),
            i.alias("last"),
            F.when(goes_on, s["n"] + 1).otherwise(F.lit(1)).alias("n"),
        )

    return F.aggregate(filled, start, step, lambda s: s["at"])


def block_list(content: Column) -> Column:
    """array<struct<line, n_lines, text>>, line counting from 1."""

    def of(ls: Column) -> Column:
        def cut(at: Column) -> Column:
            def block(i: Column, k: Column) -> Column:
                until = F.coalesce(F.get(at, k + 1), F.size(ls))
                own = F.filter(F.slice(ls, i + 1, until - i), lambda x: ~x.rlike(BLANK))
                return F.struct((i + 1).alias("line"), F.size(own).alias("n_lines"), F.array_join(own, "\n").alias("text"))

            return F.transform(at, block)

        return bind(_starts(ls), cut)

    empty = F.array().cast("array<struct<line:int,n_lines:int,text:string>>")
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, empty).otherwise(bind(lines(content), lambda ls: F.when(F.size(ls) == 0, empty).otherwise(of(ls))))


def blocks(files: DataFrame) -> DataFrame:
    """block_id, file_id, rel, line, n_lines, text from (file_id, rel, content).

    block_id is file_id and the block's place in its file, so no numbering over all
    blocks is needed."""
    cut = files.select("file_id", "rel", F.posexplode(block_list(F.col("content"))).alias("seq", "b"))
    block_id = F.shiftleft(F.col("file_id"), SEQUENCE_BITS) + F.col("seq")
    return cut.select(block_id.alias("block_id"), "file_id", "rel", "b.line", "b.n_lines", "b.text")


def hashed(blocks_: DataFrame) -> DataFrame:
    return blocks_.withColumn("hash", fnv64_bulk("text"))


def postings(blocks_: DataFrame) -> DataFrame:
    """(trigram, block_id), one row for each distinct trigram of a block."""
    return blocks_.select(F.explode(trigrams(F.col("text"))).alias("trigram"), "block_id")


def write_postings(frame: DataFrame, path: str, partitions: int = 64) -> None:
    """Sorted by trigram, so that a query's few trigrams touch few row groups."""
    frame.repartitionByRange(partitions, "trigram", "block_id").sortWithinPartitions("trigram", "block_id").write.mode("overwrite").parquet(path)
