"""Language-model scores of a hierarchical Pitman-Yor model over words.

Tokens of a text are its words, A-Z lower-cased, and one end.  There is a restaurant for
each previous word (and one for the start of a text, named by the end before it), and all
share one parent restaurant, whose base distribution knows
the V training tokens and one unknown token (which gets NEW of the base, as new draws are
mostly new words).  Customers are tokens of the training texts; each table of a context
restaurant is a customer of the parent.

Seating is sampled by blocked Gibbs: in each sweep all customers of every cell (context and
dish), however many, leave together and are seated anew given everything else.  Only the
number of tables matters to the rest, and its conditional is known: in proportion to a
generalised Stirling number times a power of the restaurant's pull.  Up to EXACT customers
it is drawn from that table, beyond from its limit law, whose first two terms agree with
the table's (so a dish with any number of customers costs constant time and memory).
Predictive probabilities are averaged over SAMPLES sweeps after BURN ones.  Discounts come
from the counts of cells with one and two customers and of dishes with one and two
contexts, over all training texts.

Data flow: texts are cut into blocks of about BLOCK bytes.  A block sends its distinct
cells (context, dish, count), packed by hash of the dish, to one of half as many buckets
(no more rows than it has distinct tokens, so rows grow with the input); a
bucket has all cells of its dishes, samples their seating, and answers each block in the
order it asked; a block then adds up its texts.  Sums over a context lie in many buckets:
each bucket sends its own, by hash of the context, and gets the whole ones back (customers
and cells before sampling; before the answers tables of each kept sweep, of contexts that
several buckets hold).  Contexts travel as 40 bits of their hash, logarithms in 24 bits.
All of that is one plan, in which the exchanges of texts and of cells are made once and
read again, so nothing but shuffle files is written, and lost ones are made again.
Sampling is seeded by bucket and repeated for the exact table totals before the answers,
which makes the averaged probabilities sum to one over the V + 1 tokens.

Defined results: null and empty texts are one end token; repeated rows are scored alike
and each counts in training; an empty table gives an empty result; with no training text
all tokens are unknown and get log10 of NEW (base: log10(0.1 / 0.1) = 0); very long texts
make a block of their own size; only doc_id, text and learn are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import words_of

THETA = 1.0
NEW = 0.9
BLOCK = 16 << 20
EXACT = 1024
BURN, SAMPLES = 2, 3
SENT = "bucket int, block int, words binary, cells binary, contexts binary, counts binary"
OFFERED = "slice int, bucket int, names binary, sums binary"
TOTALS = "bucket int, slice int, sums binary"
ANSWER = "block int, bucket int, seen binary, logs binary, n double, v double"
SCORED = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = b""
#: Names, among contexts, of pairs of sums over everything: training tokens and distinct
#: ones; cells with one and two customers; dishes with one and two contexts; cells; and
#: tables of the parent and its customers.
TOKENS, CELLS, DISHES, ALL, PARENT = range(5)
FIRST_NAME = 16


def short(hashes: np.ndarray) -> np.ndarray:
    """The names of contexts: 40 bits of their hashes, in the same order."""
    return np.maximum(hashes >> np.uint64(24), np.uint64(FIRST_NAME))


def packed(numbers: np.ndarray, width: int = 5) -> bytes:
    """Whole numbers below 256 ** width: names, sums and counts."""
    return np.ascontiguousarray(numbers, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: list[bytes], width: int = 5) -> np.ndarray:
    parts = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
    out = np.zeros((len(parts), 8), np.uint8)
    out[:, :width] = parts
    return out.view(np.uint64).ravel()


def small(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 and more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes()


def from_small(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.uint32, offset=n) if len(data) > n else []
    return out


#: Logarithms travel as multiples of this: 24 bits reach to 10 ** -16.
STEP = 16 / (1 << 24)


def rounded(logs: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-logs / STEP), (1 << 24) - 1).astype(np.uint64)


def layout(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: hashes of its distinct tokens in rising order, then for every token of
    every text (texts one after another) its place in them and the place of its context, the
    token before (an end before a text's first), and the number of tokens of each text."""
    ids: dict[bytes, int] = {END: 0}
    parts, lengths = [], np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = words_of(text)
        lengths[k] = len(words) + 1
        if words:
            parts.append(np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    n = len(ids)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, n)
    order = np.argsort(hashes)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    place = rank[flat]
    return hashes[order], place, np.append(rank[0], place[:-1]), lengths


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def cells_of(hashes: np.ndarray, place: np.ndarray, context: np.ndarray, buckets: int):
    """The distinct cells of a block, ordered by bucket, token and context: the order of
    tokens by bucket, the cells' keys, and the cell of every token."""
    order = np.argsort(bucket_of(hashes, buckets), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, cell = np.unique(rank[place] * len(hashes) + context, return_inverse=True)
    return order, keys, cell


def send(block: int, texts: list[str | None], learn: np.ndarray, buckets: int) -> pd.DataFrame:
    """SENT rows of a block, for each bucket that has any of its tokens."""
    hashes, place, context, lengths = layout(texts)
    order, keys, cell = cells_of(hashes, place, context, buckets)
    counts = np.bincount(cell, np.repeat(learn, lengths).astype(float), len(keys)).astype(np.uint32)
    token, before = np.divmod(keys, len(hashes))
    before = short(hashes[before])
    per_token = np.bincount(token, minlength=len(hashes)).astype(np.uint32)
    names = hashes[order]
    bucket = bucket_of(names, buckets)
    present, first = np.unique(bucket, return_index=True)
    edges = np.append(first, len(names))
    cell_edge = np.searchsorted(token, edges)
    rows = [
        (int(b), block, names[edges[i] : edges[i + 1]].tobytes(), per_token[edges[i] : edges[i + 1]].tobytes(), packed(before[x:y]), small(counts[x:y]))
        for i, (b, x, y) in enumerate(zip(present, cell_edge[:-1], cell_edge[1:], strict=True))
    ]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])


class Bucket:
    """All cells of the dishes of a bucket, and which of them each block asked for."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("block")
        self.blocks = rows["block"].tolist()
        names = [np.frombuffer(x, np.uint64) for x in rows["words"]]
        per = [np.frombuffer(x, np.uint32) for x in rows["cells"]]
        counts = np.concatenate([from_small(x, int(k.sum())) for x, k in zip(rows["counts"], per, strict=True)])
        self.sizes = [len(x) for x in names]
        self.cell_sizes = [int(x.sum()) for x in per]
        self.contexts, context = np.unique(unpacked(rows["contexts"].tolist()), return_inverse=True)
        self.words, self.asked = np.unique(np.concatenate(names), return_inverse=True)
        dish = np.repeat(self.asked, np.concatenate(per))
        self.asked = self.asked.astype(np.int32)
        keys, self.asked_cells = np.unique(dish * len(self.contexts) + context, return_inverse=True)
        del dish, context
        self.asked_cells = self.asked_cells.astype(np.int32)
        self.dish, self.context = (x.astype(np.int32) for x in np.divmod(keys, len(self.contexts)))
        self.c = np.bincount(self.asked_cells, counts, len(keys)).astype(np.int64)
        self.total = np.bincount(self.dish, self.c, len(self.words)).astype(np.int64)
        # Until told of other buckets, these cells are all there are.
        self.own_customers, self.own_cells = self.by_context(self.c), self.by_context(self.c > 0)
        self.customers, self.cells, self.sums = self.own_customers, self.own_cells, self.own_sums()

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, len(self.contexts))

    def own_sums(self) -> np.ndarray:
        """Pairs of sums that all buckets need, in the order of their names."""
        live = self.c > 0
        per = np.bincount(self.dish[live], minlength=len(self.words))
        pairs = [(self.c.sum(), (self.total > 0).sum()), ((self.c == 1).sum(), (self.c == 2).sum()), ((per == 1).sum(), (per == 2).sum()), (live.sum(), 0)]
        return np.array(pairs, float)

    def offered(self) -> tuple[np.ndarray, np.ndarray]:
        """Names and own sums for the other buckets to add theirs to."""
        return np.append(self.contexts, np.arange(4, dtype=np.uint64)), np.vstack([np.stack([self.own_customers, self.own_cells], 1), self.sums])

    def learn(self, sums: np.ndarray) -> None:
        """Takes the sums over all buckets of what it offered."""
        self.customers, self.cells, self.sums = sums[:-4, 0], sums[:-4, 1], sums[-4:]

    def shared(self) -> np.ndarray:
        """Which of its contexts have customers elsewhere too."""
        return np.flatnonzero(self.customers > self.own_customers)

    def discounts(self) -> tuple[float, float]:
        """Of contexts and of the parent: n1 / (n1 + 2 n2) within [0.05, 0.95]."""
        return tuple(float(np.clip(x / (x + 2 * y), 0.05, 0.95)) if x + y else 0.5 for x, y in self.sums[[CELLS, DISHES]])

    @property
    def types(self) -> float:
        return max(1.0, self.sums[TOKENS, 1])


def stirling(d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: at [c, t], of all seatings of c
    customers at t tables, up to EXACT of them."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - d * t[1:])
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, : c + 1])
    return out


def drawn(c: np.ndarray, pull: np.ndarray, d: float, numbers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells, from their distribution given c customers, in proportion to
    stirling[c, t] * pull ** t.  For many customers t - 1 is Poisson: its mean is pull times
    the quotient of the first two Stirling numbers, which tends to 1 / d."""
    t = np.minimum(c, 1).astype(float)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    starts = np.flatnonzero(np.diff(c[some], prepend=0))
    for own in np.split(some, starts[1:]) if len(some) else []:
        n = int(c[own[0]])
        # Beyond these numbers of tables nothing is left of a Poisson of the largest mean.
        mean = pull[own].max() / d
        most = min(n, 32 + int(1.5 * mean + 12 * math.sqrt(mean)))
        k = np.arange(1, most + 1)
        for at in np.array_split(own, 1 + len(own) * most // 1_000_000):
            logs = numbers[n, 1 : most + 1] + np.log(pull[at])[:, None] * k
            weight = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
            t[at] = 1 + (weight < (rng.random(len(at)) * weight[:, -1])[:, None]).sum(1)
    large = np.flatnonzero(c > EXACT)
    pole = 1 - 2 * d
    slower = c[large].astype(float) ** -d * (math.gamma(1 - d) / math.gamma(pole) if pole else 0.0)
    t[large] = np.minimum(1 + rng.poisson(pull[large] / d * (1 - slower)), c[large])
    return t


def sample(b: Bucket, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tables of cells, tables of dishes in the parent) of each kept sweep.

    Other buckets sample at the same time, as in approximate distributed Gibbs.  Of a
    context's tables there, the first of each cell is known; the others, and the parent's
    tables of other buckets, are estimated by this bucket's for each further customer and
    each dish."""
    rng = np.random.default_rng(seed)
    d1, d0 = b.discounts()
    live = np.flatnonzero(b.c > 0)
    c, k, dish = b.c[live], b.context[live], b.dish[live]
    n, own_types = len(b.contexts), max(1, len(np.unique(dish)))
    further = (b.customers - b.cells) - (b.own_customers - b.own_cells)
    own_further = max(1.0, (b.own_customers - b.own_cells).sum())
    all_further = max(0.0, b.sums[TOKENS, 0] - b.sums[ALL, 0])
    parent = b.total / max(1.0, b.sums[TOKENS, 0])
    all_tables, parent_tables = b.cells.astype(float), b.types
    numbers, numbers0 = stirling(d1), stirling(d0)
    out = []
    for sweep in range(BURN + SAMPLES):
        t = drawn(c, (THETA + d1 * all_tables[k]) * parent[dish], d1, numbers, rng)
        up = np.bincount(dish, t, len(b.words))
        rate = (t - 1).sum() / own_further
        all_tables = b.cells + np.bincount(k, t - 1, n) + further * rate
        base = (1 - NEW) / b.types
        t0 = drawn(up.astype(np.int64), (THETA + d0 * parent_tables) * base * np.ones(len(up)), d0, numbers0, rng)
        parent_tables = t0.sum() / own_types * b.types
        parent = (up - d0 * t0 + (THETA + d0 * parent_tables) * base) / (THETA + max(1.0, b.sums[ALL, 0] + rate * all_further))
        if sweep >= BURN:
            whole = np.zeros(len(b.c))
            whole[live] = t
            out.append((whole, t0))
    return out


def tables_offered(b: Bucket, kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Names and sums, for each kept sweep, of tables beyond one a cell in the contexts
    that other buckets have too, and of the parent's tables and customers."""
    at = b.shared()
    sums = np.stack([np.concatenate([(b.by_context(t) - b.own_cells)[at], [t0.sum(), t.sum()]]) for t, t0 in kept], 1)
    return np.append(b.contexts[at], np.array([PARENT, PARENT + 1], np.uint64)), sums


def answer(b: Bucket, kept: list[tuple[np.ndarray, np.ndarray]], sums: np.ndarray, bucket: int) -> pd.DataFrame:
    """ANSWER rows: for each block, training counts of its tokens and log10 averaged
    predictive probabilities of its cells, in the order it asked.  `sums` is what all
    buckets together have of tables_offered."""
    d1, d0 = b.discounts()
    at, p = b.shared(), np.zeros(len(b.c))
    base = np.where(b.total > 0, (1 - NEW) / b.types, NEW)
    for (t, t0), total in zip(kept, sums.T, strict=True):
        restaurant = b.by_context(t)
        restaurant[at] = b.cells[at] + total[:-2]
        up = np.bincount(b.dish, t, len(b.words))
        parent = (up - d0 * t0 + (THETA + d0 * total[-2]) * base) / (THETA + total[-1])
        p += (b.c - d1 * t + (THETA + d1 * restaurant[b.context]) * parent[b.dish]) / (THETA + b.customers[b.context]) / SAMPLES
    logs, seen = rounded(np.log10(p))[b.asked_cells], b.total[b.asked]
    rows, i, j = [], 0, 0
    for block, n, m in zip(b.blocks, b.sizes, b.cell_sizes, strict=True):
        rows.append((block, bucket, packed(seen[i : i + n]), packed(logs[j : j + m], 3), *b.sums[TOKENS]))
        i, j = i + n, j + m
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])


def told_logs(data: list[bytes]) -> np.ndarray:
    return unpacked(data, 3) * -STEP


def sliced(names: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of names by the slice that adds them up, the slices there are, and where
    each begins in that order."""
    at = bucket_of(names, slices)
    order = np.argsort(at, kind="stable")
    present, first = np.unique(at[order], return_index=True)
    return order, present, first


def offer(bucket: int, names: np.ndarray, sums: np.ndarray, slices: int) -> pd.DataFrame:
    """OFFERED rows of a bucket's sums, one row of them a name."""
    order, present, first = sliced(names, slices)
    rows = [(int(k), bucket, packed(names[own]), packed(sums[own])) for k, own in zip(present, np.split(order, first[1:]), strict=True)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OFFERED.split(", ")])


def taken(names: np.ndarray, totals: pd.DataFrame, slices: int, columns: int) -> np.ndarray:
    """The sums over all buckets of the names a bucket offered, from its TOTALS rows."""
    order, _, _ = sliced(names, slices)
    out = np.empty((len(names), columns))
    totals = totals.sort_values("slice")
    out[order] = unpacked(totals["sums"].tolist()).reshape(-1, columns)
    return out


def whole(offered: DataFrame, columns: int) -> DataFrame:
    """TOTALS rows: for each bucket, the sums over all buckets of the names it offered."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = [len(x) // 5 for x in rows["names"]]
        sums = unpacked(rows["sums"].tolist()).reshape(-1, columns)
        _, at = np.unique(unpacked(rows["names"].tolist()), return_inverse=True)
        total = np.stack([np.bincount(at, sums[:, k]) for k in range(columns)], 1)[at]
        parts = np.split(total, np.cumsum(lengths)[:-1])
        return pd.DataFrame({"bucket": rows["bucket"].tolist(), "slice": rows["slice"].tolist(), "sums": [packed(x) for x in parts]})

    return offered.groupBy("slice").applyInPandas(run, TOTALS)


def score(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """SCORED rows of (doc_id, text, learn); train_tokens is the number of training tokens."""
    size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    # A bucket has room for two blocks' cells: the fewer buckets, the fewer sums of contexts
    # that lie in several.  More partitions than groups, so that few groups share one.
    buckets, parts = -(-n // 2), 4 * n
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    blocked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "learn", block).repartition(parts, "block")

    def asks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], kind="stable", na_position="first")
        return send(int(rows["block"].iloc[0]), rows["text"].tolist(), rows["learn"].to_numpy(bool), buckets)

    sent = blocked.groupBy("block").applyInPandas(asks, SENT).repartition(4 * buckets, "bucket")

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        return offer(int(rows["bucket"].iloc[0]), *Bucket(rows).offered(), buckets)

    known = whole(sent.groupBy("bucket").applyInPandas(own, OFFERED), 2)

    def informed(rows: pd.DataFrame, known: pd.DataFrame) -> tuple[Bucket, int]:
        b = Bucket(rows)
        b.learn(taken(b.offered()[0], known, buckets, 2))
        return b, int(rows["bucket"].iloc[0])

    def seated(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        b, bucket = informed(rows, known)
        return offer(bucket, *tables_offered(b, sample(b, bucket)), buckets)

    sums = whole(sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(seated, OFFERED), SAMPLES)
    told = known.withColumn("tables", F.lit(False)).unionByName(sums.withColumn("tables", F.lit(True)))

    def replies(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        b, bucket = informed(rows, told[~told["tables"]])
        kept = sample(b, bucket)
        return answer(b, kept, taken(tables_offered(b, kept)[0], told[told["tables"]], buckets, SAMPLES), bucket)

    answers = sent.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(replies, ANSWER)

    def adds(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], kind="stable", na_position="first")
        hashes, place, context, lengths = layout(rows["text"].tolist())
        order, _, cell = cells_of(hashes, place, context, buckets)
        back = back.sort_values("bucket")
        big_n, v = back["n"].iloc[0], back["v"].iloc[0]
        seen = np.empty(len(hashes), np.int64)
        seen[order] = unpacked(back["seen"].tolist())
        logs = told_logs(back["logs"].tolist())
        base = np.log10((seen + 0.1) / (big_n + 0.1 * (v + 1)))
        first = np.cumsum(lengths) - lengths
        doc_id = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
        out = pd.DataFrame({"doc_id": pd.array(doc_id, "Int64"), "learn": rows["learn"].to_numpy(bool), "n_tokens": lengths})
        out["n_known"] = np.add.reduceat((seen > 0)[place].astype(np.int64), first)
        out["train_tokens"] = int(big_n)
        out["base_score"] = np.add.reduceat(base[place], first)
        out["score"] = np.add.reduceat(logs[cell], first)
        return out

    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(adds, SCORED)
