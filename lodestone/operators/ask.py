"""Hybrid questions: lexical and semantic rankings fused, and reranked where that is possible.

`ask` first makes the vectors that are missing; `ask_fast` never does: blocks without one
take part in the lexical ranking only, and the answer says how many have one.  A provider
that can't be reached costs the semantic ranking, never the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import occurrences
from lodestone.operators import search, vectors
from lodestone.operators.providers import Provider, ProviderError

WARM = 0.95


def fused(blocks: DataFrame, held: DataFrame, question: str, query: list[float], limit: int) -> DataFrame:
    """(block_id, score) of the best blocks (block_id, hash, text) by both rankings; held
    has (hash, embedding)."""
    near = vectors.nearest(blocks.select("block_id", "hash").join(held, "hash"), query, vectors.LIST_SIZE, "block_id")
    lexical = search.search(blocks, question, vectors.LIST_SIZE).select("block_id", "occurrences", F.octet_length("text").alias("size"))
    lists = [vectors.ranked(near, [F.desc("score"), F.col("block_id")]), vectors.ranked(lexical, [F.desc("occurrences"), F.col("size"), F.col("block_id")])]
    return vectors.fuse(lists, "block_id", limit)


@dataclass
class Answer:
    """Hits (dicts in order, with score), how they were ranked, and what to know of it."""

    query: str
    provider: str
    hits: list[dict]
    ranked_by: str
    coverage: float
    warning: str | None = None

    def envelope(self) -> dict:
        out = {"query": self.query, "provider": self.provider, "coverage": round(self.coverage, 2), "ranked_by": self.ranked_by, "count": len(self.hits), "hits": self.hits}
        if self.warning:
            out["warning"] = self.warning
        elif self.coverage < WARM:
            out["warming_up"] = True
        return out


def hit_rows(blocks: DataFrame, scored: DataFrame, question: str) -> list[dict]:
    """The blocks of a bounded list of (block_id, score), best first."""
    n = occurrences(F.col("text"), question) if question else F.lit(0).cast("long")
    rows = blocks.join(F.broadcast(scored), "block_id").withColumn("occurrences", n).orderBy(F.desc("score"), "block_id")
    return [r.asDict() for r in rows.select("block_id", "rel", "line", "occurrences", "score", "text").collect()]


def ask_fast(blocks: DataFrame, held: DataFrame, provider: Provider, question: str, limit: int) -> Answer:
    """An answer from the vectors there are.  The question's vector and the reranker are one
    request each, whatever the corpus."""
    limit = min(limit, search.MOST_LIMIT)
    try:
        query = provider.embed_query(question)
    except ProviderError as e:
        found = search.search(blocks, question, limit).select("block_id", F.lit(0.0).alias("score"), "rel", "line", "occurrences", "text")
        return Answer(question, provider.identity, [r.asDict() for r in found.collect()], "lexical", 0.0, f"no semantic ranking ({e}): results are lexical only")
    covered = vectors.coverage(blocks, held).first()["coverage"]
    pool = vectors.pool_size(limit) if provider.rerank_model else limit
    rows = hit_rows(blocks, fused(blocks, held, question, query, pool), question)
    order = rerank(provider, question, rows, limit)
    return Answer(question, provider.identity, order or rows[:limit], "rerank" if order else "rrf", covered)


def rerank(provider: Provider, question: str, rows: list[dict], limit: int) -> list[dict] | None:
    """Rows in the reranker's order with its scores; None where there is no reranker,
    nothing to reorder or no usable reply: reranking never fails a question."""
    if not provider.rerank_model or len(rows) < 2:
        return None
    try:
        found = provider.scores(question, [(r["text"] or "")[: vectors.RERANK_CHARS] for r in rows])
    except ProviderError:
        return None
    out, used = [], set()
    for index, score in found[:limit]:
        if 0 <= index < len(rows) and index not in used:
            used.add(index)
            out.append(rows[index] | {"score": score})
    return out or None


def missing_made(blocks: DataFrame, held: DataFrame, provider: Provider) -> DataFrame:
    """(hash, embedding) of the contents of blocks that have no vector in held."""
    return vectors.embed_with(vectors.missing(blocks, held.select("hash")), lambda: provider.embed, provider.batch)
