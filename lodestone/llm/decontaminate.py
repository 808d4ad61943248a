"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is the shortest run of SHORTEST to LONGEST words, from each place of a test item,
that the whole corpus would hold by chance less than RARE times, going by the frequencies
of its words in all documents (leaked items don't make their own seeds common this way).
Where no run gets that rare, the seed is the longest one up to LONGEST words that the item
has left there; the last SHORTEST - 1 places start none.  Training passages that hold a seed
meet the item there: the words around it are aligned with the whole item, and a pair
counts when the best local alignment reaches THRESHOLD of the item's length (a match 1, a
mismatch or gap -0.5), which finds exact, edited and paraphrased copies.  Passages of an
item that overlap are aligned as one, so a text costs at most its length times the item's,
however often its seeds repeat, and memory in proportion to its length.

Test items go to the tasks in blocks of at most BLOCK_WORDS words, one pass over the
documents for each block, so what is broadcast has a bound whatever the benchmark's size.

Defined results: null, empty and blank texts match nothing; items of fewer than LEAST words
are not compared, being no evidence of a leak; repeated documents and items each get their
own rows (an item_id that repeats is reported once for each document and text); an empty
table on either side gives an empty result; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import LINK, Vocabulary, words_of

SHORTEST, LONGEST = 3, 8
RARE = 0.2
LEAST = 5
THRESHOLD = 0.5
PENALTY = 0.5
BLOCK_WORDS = 1_000_000
FOUND = "doc_id long, item_id long, score double, start_word int, end_word int"
TABLE_BITS = 22


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def longer(runs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word runs, from those of n-1 words."""
    out = runs[: max(0, len(hashes) - n + 1)]
    return (out * np.uint64(LINK)) ^ (hashes[n - 1 :][: len(out)] + (out >> np.uint64(29)))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: score, and its span in the passage.

    Row by row; gaps along a row are a running maximum."""
    m, n = len(item), len(passage)
    h, origin = np.zeros(n + 1), np.arange(n + 1)
    ramp = PENALTY * np.arange(n + 1)
    best = (0.0, 0, 0)
    for i in range(m):
        step = np.where(passage == item[i], 1.0, -PENALTY)
        diagonal = h[:-1] + step
        up = h[1:] - PENALTY
        new = np.zeros(n + 1)
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start = np.arange(n + 1)
        start[1:] = np.where(new[1:] <= 0, start[1:], np.where(diagonal >= up, origin[:-1], origin[1:]))
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        place = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        gapped = top - ramp
        start = np.where(gapped > new, start[place], start)
        h, origin = np.maximum(new, gapped), start
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (float(h[j]), int(origin[j]), j)
    return best


class Index:
    """The seeds of a block of items: of each, its item and its first and last place there."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], counts: dict[bytes, int], total: int):
        self.items: list[tuple[int | None, np.ndarray]] = []
        seeds: dict[int, dict[tuple[int, int], list[int]]] = {}
        for item_id, words in items:
            if len(words) < LEAST:
                continue
            at = len(self.items)
            hashes = np.array([word_hash(w) for w in words], np.uint64)
            self.items.append((item_id, hashes))
            chance = [max(1, counts.get(w, 0)) / max(1, total) for w in words]
            runs = {1: hashes}
            for n in range(2, LONGEST + 1):
                runs[n] = longer(runs[n - 1], hashes, n)
            for i in range(len(words) - SHORTEST + 1):
                expected = total * chance[i] * chance[i + 1]
                most = min(LONGEST, len(words) - i)
                for n in range(SHORTEST, most + 1):
                    expected *= chance[i + n - 1]
                    if expected < RARE or n == most:
                        seeds.setdefault(n, {}).setdefault((int(runs[n][i]), at), [i, i])[1] = i
                        break
        self.by_length = {}
        for n, places in seeds.items():
            rows = sorted((key, at, low, high) for (key, at), (low, high) in places.items())
            key = np.array([r[0] for r in rows], np.uint64)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.by_length[n] = (key, [r[1:] for r in rows], table)

    def passages(self, hashes: np.ndarray) -> dict[int, list[np.ndarray]]:
        """Of each item met in a text, where passages begin and end that may hold it."""
        runs, met = hashes, {}
        for n in range(2, LONGEST + 1):
            runs = longer(runs, hashes, n)
            if not len(runs):
                break
            if n not in self.by_length:
                continue
            key, seeds, table = self.by_length[n]
            where = np.flatnonzero(table[(runs >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            if not len(where):
                continue
            low, high = np.searchsorted(key, runs[where], "left"), np.searchsorted(key, runs[where], "right")
            order = np.argsort(low, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
                at = where[own]
                for k in range(int(low[own[0]]), int(high[own[0]])):
                    item, first, last = seeds[k]
                    m = len(self.items[item][1])
                    slack = 5 + m // 4
                    met.setdefault(item, []).append(np.stack([at - last - slack, at - first + m + slack]))
        return met

    def find(self, hashes: np.ndarray) -> list[tuple[int | None, float, int, int]]:
        """(item_id, score, first word, word after the last) of each item in one text."""
        out = []
        for item, found in sorted(self.passages(hashes).items()):
            item_id, words = self.items[item]
            begin, end = np.concatenate(found, 1)
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            apart = np.flatnonzero(begin[1:] > end[:-1])
            best = (0.0, 0, 0)
            for a, b in zip(np.append(begin[0], begin[1:][apart]), np.append(end[:-1][apart], end[-1]), strict=True):
                a, b = max(0, int(a)), min(len(hashes), int(b))
                score, x, y = align(words, hashes[a:b])
                if score > best[0]:
                    best = (score, a + x, a + y)
            if best[0] >= THRESHOLD * len(words):
                out.append((item_id, best[0] / len(words), *best[1:]))
        return out


def word_counts(docs: DataFrame, wanted: set[bytes]) -> tuple[dict[bytes, int], int]:
    """How often each wanted word occurs in all documents, and the number of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, total = dict.fromkeys(wanted, 0), 0
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                total += len(words)
                for w in words:
                    if w in counts:
                        counts[w] += 1
        rows = [(w, n) for w, n in counts.items() if n] + [(None, total)]
        yield pd.DataFrame(rows, columns=["word", "n"])

    rows = docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r[0]): r[1] for r in rows if r[0] is not None}, sum(r[1] for r in rows if r[0] is None)


def blocks(benchmark: DataFrame) -> list[list[tuple[int | None, list[bytes]]]]:
    """Test items, read in blocks of about BLOCK_WORDS words."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * BLOCK_WORDS)))
    keyed = benchmark.select(F.col("item_id").cast("long"), "text").withColumn("_k", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    out = []
    for k in range(n):
        rows = sorted(((r[0], r[1] or "") for r in keyed.filter(F.col("_k") == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        out.append([(i, words_of(t)) for i, t in rows])
    return out


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Broadcast]:
    """The seed index of each block of items, broadcast; its size has a bound."""
    for items in blocks(benchmark):
        wanted = {w for _, words in items for w in words}
        counts, total = word_counts(docs, wanted) if wanted else ({}, 0)
        yield docs.sparkSession.sparkContext.broadcast(Index(items, counts, total))


def finder(index: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, seeds = Vocabulary(), index.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for item_id, score, a, b in seeds.find(vocabulary.hashed(words_of(text))):
                    out.append((None if pd.isna(doc_id) else int(doc_id), item_id, round(score, 6), a, b))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64", "start_word": "int32", "end_word": "int32"})

    return run


def leaking(index: Broadcast):
    def run(texts: pd.Series) -> pd.Series:
        vocabulary, seeds = Vocabulary(), index.value
        return pd.Series([bool(seeds.find(vocabulary.hashed(words_of(t)))) for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """FOUND rows: each document and test item that align, with the share of the item's
    length that the alignment scores and its place in the document's words."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [texts.mapInPandas(finder(i), FOUND) for i in indexes(docs, benchmark)])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that match an item.  Each row's text is judged where it is."""
    for index in indexes(docs, benchmark):
        docs = docs.filter(~leaking(index)("text"))
    return docs
