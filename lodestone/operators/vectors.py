"""Vectors keyed by content hash, exact nearest neighbours, fusion and reranking."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fnv_many

RRF_K = 60
LIST_SIZE = 200
POOL_FACTOR, POOL_MOST = 4, 100
RERANK_CHARS = 4000
WORDS = re.compile(r"[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def embed(texts: list[str | None], dim: int = 256) -> np.ndarray:
    """Hashed bags of words (weight 1) and of byte trigrams (weight 1/2), of length one.

    A feature adds its weight at its hash and half of it at the hash's upper half."""
    dim = max(16, dim)
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        low = (text or "").lower()
        data = low.encode()
        words = [w.encode() for w in WORDS.findall(low)]
        words = [w for w in words if len(w) >= 2]
        grams = [data[i : i + 3] for i in range(len(data) - 2)]
        h = fnv_many([*words, *grams])
        weight = np.array([1.0] * len(words) + [0.5] * len(grams))
        np.add.at(out[row], (h % np.uint64(dim)).astype(np.int64), weight)
        np.add.at(out[row], ((h >> np.uint64(32)) % np.uint64(dim)).astype(np.int64), weight / 2)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def hash_embed(text: Column, dim: int = 256) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed(texts.tolist(), dim)))

    return F.pandas_udf(run, "array<float>")(text)


Provider = Callable[[list[str]], list[list[float]]]


def embed_with(missing: DataFrame, provider: Callable[[], Provider], batch: int = 64) -> DataFrame:
    """(hash, embedding) of (hash, text) by any provider, in batches of a partition.

    `provider` makes the client on the executor; its vectors are brought to length one,
    and a reply of another size is an error."""

    def run(batches):
        call = provider()
        for frame in batches:
            texts, out = frame["text"].tolist(), []
            for k in range(0, len(texts), batch):
                part = call(texts[k : k + batch])
                if len(part) != len(texts[k : k + batch]):
                    raise ValueError("the provider returned another number of vectors")
                for v in part:
                    v = np.asarray(v, np.float32)
                    n = float(np.linalg.norm(v))
                    out.append(v / n if n else v)
            yield pd.DataFrame({"hash": frame["hash"], "embedding": out})

    return missing.select("hash", "text").mapInPandas(run, "hash string, embedding array<float>")


def missing(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(hash, text) of blocks without a vector, one row for each content."""
    return blocks.groupBy("hash").agg(F.min("text").alias("text")).join(vectors, "hash", "left_anti")


def collect_garbage(vectors: DataFrame, blocks: DataFrame) -> DataFrame:
    return vectors.join(blocks.select("hash").distinct(), "hash", "left_semi")


def coverage(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The share of blocks that have a vector; 1 without blocks."""
    known = blocks.select("hash").join(vectors.select("hash", F.lit(1).alias("v")).distinct(), "hash", "left")
    return known.agg(F.count("*").alias("blocks"), F.count("v").alias("covered"), F.coalesce(F.round(F.avg(F.when(F.col("v").isNotNull(), 1.0).otherwise(0.0)), 6), F.lit(1.0)).alias("coverage"))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows with the largest inner product with one query; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(dot(F.col(column), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block: int = 256) -> DataFrame:
    """(query_id, key, score, rank): the exact k nearest of each query, queries in blocks.

    A block of queries (dealt by hash, about `block` vectors) is a matrix that every partition
    multiplies with its batches; each batch passes on its k best for each query, so the
    shuffle holds k rows for a query and batch, never all pairs."""
    spark = vectors.sparkSession
    best = None
    blocks = -(-queries.count() // block)
    dealt = queries.select("query_id", column, F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))).alias("_n"))
    for k_block in range(blocks):
        got = dealt.filter(F.col("_n") == k_block).collect()
        if not got:
            continue
        held = spark.sparkContext.broadcast(([r[0] for r in got], np.array([r[1] for r in got], np.float64)))
        part = vectors.select(key, column).mapInPandas(_multiply(held, k, key, column), f"query_id long, {key} long, score double")
        best = part if best is None else best.union(part)
    if best is None:
        return spark.createDataFrame([], f"query_id long, {key} long, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _multiply(held, k: int, key: str, column: str):
    def run(batches):
        ids, q = held.value
        for frame in batches:
            if not len(frame):
                continue
            names = frame[key].to_numpy()
            scores = np.round(np.stack(frame[column].to_numpy()).astype(np.float64) @ q.T, 6)
            out = []
            for j, query in enumerate(ids):
                order = np.lexsort((names, -scores[:, j]))[:k]
                out.append(pd.DataFrame({"query_id": query, key: names[order], "score": scores[order, j]}))
            yield pd.concat(out)

    return run


def ranked(scored: DataFrame, order: list, most: int = LIST_SIZE) -> DataFrame:
    """Places from 0 of the first `most` rows of a list."""
    few = scored.orderBy(*order).limit(most)
    return few.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(lists: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Reciprocal rank fusion of lists of (key, place): the sum of 1 / (60 + place)."""
    every = lists[0].select(key, "place")
    for x in lists[1:]:
        every = every.union(x.select(key, "place"))
    summed = every.groupBy(key).agg(F.round(F.sum(1 / (F.lit(float(RRF_K)) + F.col("place"))), 6).alias("score"))
    return summed.orderBy(F.desc("score"), key).limit(limit)


def pool_size(limit: int) -> int:
    """How many fused hits a reranker sees."""
    return max(limit, min(POOL_FACTOR * limit, POOL_MOST))


def apply_order(hits: DataFrame, order: DataFrame, limit: int) -> DataFrame:
    """hits (idx, ...) in a reranker's order (pos, idx): its first `limit` entries, of which
    repeated and unknown ones are skipped."""
    first = order.filter(F.col("pos") < limit).groupBy("idx").agg(F.min("pos").alias("pos"))
    return hits.join(first, "idx").orderBy("pos")


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], list[tuple[int, float]]] | None, limit: int) -> tuple[DataFrame, bool]:
    """Hits (of which the first pool_size count, with a text column) in a scorer's order, and
    whether it was used: without a scorer, or with one hit, the fused order stays.  A
    scorer gives (index, relevance) pairs for texts cut to RERANK_CHARS characters."""
    rows = hits.limit(pool_size(limit)).collect()
    if scorer is None or len(rows) < 2:
        return hits.limit(limit), False
    try:
        found = scorer(query, [(r["text"] or "")[:RERANK_CHARS] for r in rows])
    except Exception:  # a remote scorer may fail in any way; the fused order is the fallback
        return hits.limit(limit), False
    order = [i for i, _ in sorted(found, key=lambda x: -x[1])][:limit]
    picked = [rows[i] for i in dict.fromkeys(order) if 0 <= i < len(rows)]
    return hits.sparkSession.createDataFrame(picked, hits.schema), True
