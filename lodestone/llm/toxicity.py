"""Toxic spans by a linear-chain conditional random field.

Labelled tokens come from document labels: in a bounded sample of labelled documents
(SAMPLE toxic and SAMPLE other ones at most, a documented limit on fitting only), a word,
or a prefix of it, that occurs in toxic documents far more often than its chance in others
marks its tokens as toxic.  The field then learns, from identity, affixes and shape of
words, to tag these tokens in context.  Scoring covers every token of every text:
forward-backward marginals give offending offsets, and a logistic link turns a text's
strongest marginals into a document score.

Chains end at sentence ends.  Long ones are worked on in pieces side by side, with the same
result, so time and memory stay in proportion to a text, whatever its length.

Defined results: null, empty and blank texts get the score of a text without any toxic
token and no spans; repeated rows are scored alike; an empty table gives an empty result;
without labels of both kinds every text gets the share of toxic labels (0.0 if none).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 1000
PIECE = 64
BUCKETS = 1 << 17
PURITY = 5
WIDTH = 6
AFFIXES = 4
#: Tokens that training works on at a time, and parts in which the sample comes to the driver.
BLOCK = 1 << 16
PARTS = 8
#: What the rounds of training leave out in turn: nothing, identity, identity and suffix, and
#: these with the longest prefix.
LEFT_OUT = ((), (0,), (0, 4), (0, 3, 4))
TOKEN = re.compile(r"\S+")
TRIM = ".,;:!?'\"()[]{}<>*#%$&|-_~`«»…"
SPANS = "score double, n_spans int, spans array<struct<start:int,end:int,marginal:double>>"


def normal(token: str) -> str:
    return token.strip(TRIM).lower()


def affixes(word: str) -> list[str]:
    """A word and its prefixes of four to six letters, where the word goes on."""
    return ["=" + word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


def features(word: str) -> list[int]:
    """WIDTH places in the weights: identity, prefixes, suffix and bias; 0 for none."""
    import xxhash

    names = affixes(word)
    names = [*names, *[""] * (WIDTH - 2 - len(names)), "$" + word[-3:], "1"]
    return [1 + xxhash.xxh32_intdigest(x) % (BUCKETS - 1) if x else 0 for x in names]


def segments(tokens: list[str]) -> np.ndarray:
    """Where chains begin: at the start and after each sentence end."""
    starts = np.zeros(len(tokens), bool)
    if len(tokens):
        starts[0] = True
        starts[1:] = [t[-1] in ".!?" for t in tokens[:-1]]
    return starts


def marginals(emission: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token by forward-backward over chains laid end to end.

    emission: log-odds of toxic; trans[a, b]: score of b after a.  All chains advance
    together, one position at a time, in probability space with rescaling.  Chains longer
    than PIECE are cut there, and the pieces too advance together: their two-by-two
    transfer matrices tell what comes into each from both sides, so the result is that of
    the whole chain.  Also gives the pair marginals summed, and the log-partition."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), np.float64(0.0)
    psi, m = np.exp(np.clip(emission, -30, 30)), np.exp(trans)
    chain = np.flatnonzero(starts)
    sizes = np.diff(np.append(chain, n))
    many = -(-sizes // PIECE)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)  # of a piece in its chain
    first = np.repeat(chain, many) + PIECE * place
    length = np.minimum(PIECE, np.repeat(chain + sizes, many) - first)
    last = first + length - 1

    def forward(pieces: np.ndarray, into: np.ndarray | None, keep: bool) -> np.ndarray:
        """What leaves pieces, given what comes into them (None: they begin chains)."""
        order = pieces[np.argsort(-length[pieces], kind="stable")]
        x = np.ones((len(order), 2)) if into is None else into[np.argsort(-length[pieces], kind="stable")]
        left = length[order]
        total = np.zeros(len(order))
        for k in range(int(left[0])):
            live = int(np.searchsorted(-left, -k, side="left"))
            at, p = first[order[:live]] + k, x[:live]
            if k == 0 and into is None:
                x0, x1 = np.ones(live), psi[at]
            else:
                x0 = p[:, 0] * m[0, 0] + p[:, 1] * m[1, 0]
                x1 = (p[:, 0] * m[0, 1] + p[:, 1] * m[1, 1]) * psi[at]
            s = x0 + x1
            x[:live, 0], x[:live, 1] = x0 / s, x1 / s
            if keep:
                scale[at], a[at] = s, x[:live]
            else:
                total[:live] += np.log(s)
        if keep:
            return x
        out = np.empty((len(pieces), 3))
        out[np.argsort(-length[pieces], kind="stable")] = np.column_stack([x, total])
        return out

    a, b, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    pairs = np.zeros((2, 2))
    begins, goes_on = np.flatnonzero(place == 0), np.flatnonzero(place > 0)
    forward(begins, None, True)
    if len(goes_on):
        basis = [forward(goes_on, np.tile(e, (len(goes_on), 1)), False) for e in ((1.0, 0.0), (0.0, 1.0))]
        top = np.maximum(basis[0][:, 2], basis[1][:, 2])
        move = np.zeros((len(first), 2, 2))
        for k in range(2):
            move[goes_on, k] = basis[k][:, :2] * np.exp(basis[k][:, 2] - top)[:, None]
        into = np.zeros((len(first), 2))
        for level in range(1, int(place.max()) + 1):
            own = np.flatnonzero(place == level)
            before = own - 1
            x = a[last[before]] if level == 1 else np.einsum("ni,nij->nj", into[before], move[before])
            into[own] = x / x.sum(1, keepdims=True)
        forward(goes_on, into[goes_on], True)
        for level in range(int(place.max()), 0, -1):
            own = np.flatnonzero(place == level)
            x = np.einsum("nij,nj->ni", move[own], b[last[own]])
            b[last[own - 1]] = x / x.sum(1, keepdims=True)
    order = np.argsort(-length, kind="stable")
    begin, left = first[order], length[order]
    for k in range(int(left[0]) - 1, -1, -1):
        at = begin[: int(np.searchsorted(-left, -k, side="left"))] + k
        if k == 0:
            at = at[~starts[at]]
        q = np.stack([b[at, 0] / scale[at], b[at, 1] * psi[at] / scale[at]], 1)
        p = a[at - 1]
        joint = p[:, :, None] * m * q[:, None, :]
        pairs += (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0)
        if k:
            b[at - 1] = q @ m.T
    top = a[:, 1] * b[:, 1]
    return top / np.maximum(top + a[:, 0] * b[:, 0], 1e-300), pairs, np.log(scale).sum()


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    link: np.ndarray
    fallback: float | None = None

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.trans, self.link, self.fallback

    def __setstate__(self, state):
        self.weights, self.trans, self.link, self.fallback = state
        self.known = {}

    def emission(self, words: list[str]) -> np.ndarray:
        """Log-odds of each token.  A worker remembers a bounded number of distinct words."""
        known = self.known
        if len(known) > 300_000:
            known.clear()
        fresh = {w for w in words if w not in known}
        if fresh:
            fresh = list(fresh)
            rows = np.array([features(normal(w)) for w in fresh], np.int64)
            known.update(zip(fresh, self.weights[rows].sum(1).tolist(), strict=True))
        return np.fromiter((known[w] for w in words), float, len(words))

    def chances(self, texts: list[list[str]]) -> list[np.ndarray]:
        flat = [t for tokens in texts for t in tokens]
        if not flat:
            return [np.zeros(0) for _ in texts]
        starts = np.concatenate([segments(t) for t in texts if t])
        p, _, _ = marginals(self.emission(flat), starts, self.trans)
        return np.split(p, np.cumsum([len(t) for t in texts])[:-1])

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(summary(p) @ self.link, -40, 40))))


def summary(p: np.ndarray) -> np.ndarray:
    """What the document score sees: the strongest marginal and the damped sum of sure ones."""
    return np.array([1.0, p.max() if len(p) else 0.0, np.log1p(p[p > 0.5].sum()) if len(p) else 0.0])


class Sample:
    """Texts to learn from: four bytes a token, and what each distinct token stands for.

    Texts go once they are added, so that what the driver holds is a small part of them."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.texts: list[np.ndarray] = []
        self.toxic: list[bool] = []
        self.traits, self.names = array("i"), array("Q")
        self.ends = bytearray()

    def add(self, text: str | None, toxic: bool) -> None:
        import xxhash

        tokens = TOKEN.findall(text or "")
        at = array("i")
        for token in tokens:
            k = self.numbers.get(token)
            if k is None:
                k = self.numbers[token] = len(self.numbers)
                word = normal(token)
                held = [xxhash.xxh3_64_intdigest(x) or 1 for x in affixes(word)] if len(word) >= 3 else []
                self.traits.extend(features(word))
                self.names.extend(held + [0] * (AFFIXES - len(held)))
                self.ends.append(token[-1] in ".!?")
            at.append(k)
        self.texts.append(np.array(at, np.int32))
        self.toxic.append(bool(toxic))

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct token: features, numbers of affixes (0: none), whether it ends a
        sentence.  The tokens themselves go."""
        self.numbers = {}
        names = np.frombuffer(self.names, np.uint64)
        distinct = np.unique(np.append(names, np.uint64(0)))
        numbers = np.searchsorted(distinct, names).astype(np.int32).reshape(-1, AFFIXES)
        traits, ends = np.frombuffer(self.traits, np.int32), np.frombuffer(self.ends, bool)
        self.traits, self.names, self.ends = array("i"), array("Q"), bytearray()
        return traits.reshape(-1, WIDTH), numbers, ends


def seeds(texts: list[np.ndarray], toxic: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which words and prefixes mark toxic documents: at equal class sizes PURITY times as
    many toxic documents would have them, or have them more than once, as others, beyond
    chance (a log-likelihood ratio above the logarithm of the number of features tried).
    names: the numbers of each token's affixes.  Equal texts count once."""
    count = np.zeros((4, 1 + int(names.max(initial=0))), np.int32)  # others and toxic ones that have it, and more than once
    once = {hashlib.sha256(x.tobytes()).digest(): k for k, x in enumerate(texts)}
    for k in once.values():
        words, n = np.unique(texts[k], return_counts=True)
        held, place = np.unique(names[words], return_inverse=True)
        n = np.bincount(place.ravel(), np.repeat(n, AFFIXES), len(held))
        t = int(toxic[k])
        count[t, held] += 1
        count[2 + t, held[n > 1]] += 1
    count[:, 0] = 0
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    tests = int((count[0] + count[1] >= 3).sum() + (count[2] + count[3] >= 3).sum())
    found = np.zeros(count.shape[1], bool)
    for c0, c1 in (count[:2], count[2:]):
        tried = np.flatnonzero((c1 >= 3) & (c1 / n1 >= PURITY * c0 / n0))
        c0, c1 = c0[tried], c1[tried]
        rate = (c0 + c1) / (n0 + n1)
        gain = c1 * np.log(c1 / n1 / rate) + np.where(c0 > 0, c0 * np.log(np.maximum(c0, 1) / n0 / rate), 0.0)
        found[tried[gain > np.log(max(2, tests))]] = True
    return found


def blocks(starts: np.ndarray) -> list[slice]:
    """Whole chains laid end to end, BLOCK tokens at a time or, if it is longer, one chain."""
    chain = np.append(np.flatnonzero(starts), len(starts))
    out, i = [], 0
    while i < len(chain) - 1:
        j = max(i + 1, int(np.searchsorted(chain, chain[i] + BLOCK, side="right")) - 1)
        out.append(slice(int(chain[i]), int(chain[j])))
        i = j
    return out


def emissions(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-odds of each distinct token, a block of them at a time."""
    return np.concatenate([np.zeros(0), *(weights[rows[k : k + BLOCK]].sum(1) for k in range(0, len(rows), BLOCK))])


def train(rows: Iterable[tuple[str | None, int]], share: float | None = None, epochs: int = 60, rate: float = 0.3) -> Model:
    """Fits the field by adaptive gradients on chains that hold a labelled toxic token and
    four times as many tokens of others, and the document link on all sampled documents,
    weighted so that `share` of them (as in the sample, if not given) are toxic."""
    sample = Sample()
    for text, label in rows:
        sample.add(text, label)
    return learn(sample, share, epochs, rate)


def learn(sample: Sample, share: float | None = None, epochs: int = 60, rate: float = 0.3) -> Model:
    """`train` on texts that were added one by one."""
    texts, toxic = sample.texts, np.array(sample.toxic, bool)
    sampled = float(toxic.mean()) if len(texts) else 0.0
    share = sampled if share is None else share
    blank = Model(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(3), share)
    if not toxic.any() or toxic.all():
        return blank
    traits, names, ends = sample.close()
    marks = seeds(texts, toxic, names)
    if not marks.any():
        return blank
    tagged = marks[names].any(1)
    del names

    def begins(words: np.ndarray) -> np.ndarray:
        s = np.ones(len(words), bool)
        s[1:] = ends[words[:-1]]
        return s

    tokens, gold, starts = [], [], []
    spare = 0
    for k in np.argsort(~toxic, kind="stable"):
        words, t = texts[k], toxic[k]
        if not len(words):
            continue
        y, s = tagged[words], begins(words)
        cut = np.append(np.flatnonzero(s), len(words))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            hot = y[i:j].any()
            if (hot and t) or spare > 0:
                spare += 4 * (j - i) if hot and t else -(j - i)
                tokens.append(words[i:j])
                gold.append(y[i:j] & t)
                starts.append(s[i:j])
    y, starts = np.concatenate(gold), np.concatenate(starts)
    used, at = numbered(np.concatenate(tokens), len(traits))
    del tokens, gold
    rows_of = traits[used]
    weights, trans = np.zeros(BUCKETS), np.zeros((2, 2))
    g2, t2 = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    inside = ~starts[1:]
    gold_pairs = np.array([[(inside & (y[:-1] == i) & (y[1:] == j)).sum() for j in range(2)] for i in range(2)], float)
    parts = blocks(starts)
    for epoch in range(epochs):
        # Words go without their more special features in turn, so that what they share
        # with words not met here has to tell the tags too.
        seen = rows_of.copy()
        seen[:, list(LEFT_OUT[epoch % len(LEFT_OUT)])] = 0
        e = emissions(weights, seen)
        by_word, pairs = np.zeros(len(used)), np.zeros((2, 2))
        for part in parts:
            p, moved, _ = marginals(e[at[part]], starts[part], trans)
            by_word += np.bincount(at[part], y[part] - p, len(used))
            pairs += moved
        grad = -0.02 * weights
        for k in range(WIDTH):
            grad += np.bincount(seen[:, k], by_word, BUCKETS)
        grad[0] = 0.0
        g2 += grad * grad
        weights += rate * grad / np.sqrt(g2)
        tgrad = gold_pairs - pairs - 0.1 * trans
        t2 += tgrad * tgrad
        trans += rate * tgrad / np.sqrt(t2)
    e = emissions(weights, traits)
    x = np.empty((len(texts), 3))
    sizes = np.cumsum([len(words) for words in texts])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] - len(texts[i]) + BLOCK, side="right")))
        flat = np.concatenate(texts[i:j])
        p, _, _ = marginals(e[flat], np.concatenate([begins(words) for words in texts[i:j]]), trans)
        x[i:j] = [summary(q) for q in np.split(p, np.cumsum([len(words) for words in texts[i:j]])[:-1])]
        i = j
    link, prior = np.zeros(3), np.array([0.01, 0.01, 0.01])
    weight = np.where(toxic, share / sampled, (1 - share) / (1 - sampled))
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(prior), x.T @ (weight * (toxic - q)) - prior * link)
        link = link + np.clip(step, -4, 4)
    return Model(weights, trans, link)


def numbered(tokens: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur, of `distinct` ones, as they first come, and the place of each
    token among them."""
    first = np.full(distinct, len(tokens), np.int32)
    for k in reversed(range(0, len(tokens), BLOCK)):
        part = tokens[k : k + BLOCK]
        first[part[::-1]] = np.arange(k + len(part) - 1, k - 1, -1, dtype=np.int32)
    used = np.flatnonzero(first < len(tokens))
    used = used[np.argsort(first[used])]
    rank = np.zeros(distinct, np.int32)
    rank[used] = np.arange(len(used), dtype=np.int32)
    return used, rank[tokens]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic): at most `sample` documents of
    each class, chosen by a hash of doc_id, so that the same tables give the same model.
    Only ids are joined and sorted; texts are read for the chosen ones.  Rows of one doc_id
    are one document, with the least of their texts."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    ids: dict[int, int] = {}
    counts = {r[0]: r[1] for r in there.groupBy("y").count().collect()}
    for y in (0, 1):
        ids |= {r[0]: y for r in there.filter(F.col("y") == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if not ids:
        return train([])
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, y int")
    # Texts come to the driver one a document, a part at a time, and go once they are read.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    least = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).coalesce(PARTS)
    read, came = Sample(), []
    for doc_id, text, y in least.toLocalIterator():
        read.add(text, y)
        came.append(doc_id)
    order = sorted(range(len(came)), key=lambda k: -came[k])
    read.texts, read.toxic = [read.texts[k] for k in order], [read.toxic[k] for k in order]
    return learn(read, counts.get(1, 0) / sum(counts.values()))


def tag(model: Model, text: Column, spans: bool = True) -> Column:
    """score, number of spans and spans (code point offsets) of each whole text."""
    shared = model

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        values = texts.tolist()
        for k in range(0, len(values), 256):
            part = [TOKEN.findall(t or "") for t in values[k : k + 256]]
            for t, p in zip(values[k : k + 256], shared.chances(part), strict=True):
                score = shared.score(p) if shared.fallback is None else shared.fallback
                hits = np.flatnonzero(p > 0.5)
                found = []
                if len(hits) and spans:
                    where = {i: m for i, m in enumerate(TOKEN.finditer(t)) if p[i] > 0.5}
                    groups = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
                    found = [{"start": where[int(g[0])].start(), "end": where[int(g[-1])].end(), "marginal": float(p[g].max())} for g in groups]
                out.append((score, int((np.diff(hits) > 1).sum() + 1) if len(hits) else 0, found))
        return pd.DataFrame(out, columns=["score", "n_spans", "spans"])

    return F.pandas_udf(run, SPANS)(text)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with one more column `_toxicity`: score, n_spans, spans."""
    return docs.withColumn("_toxicity", tag(model, F.col(text)))
