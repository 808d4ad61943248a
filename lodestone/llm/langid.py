"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes (all of them, the last one padded), each begun so
far before the end of the one before that no filter misses a cut.  Filters of
several widths slide over the bytes, their responses are rectified and max-pooled, and a
softmax over the pooled features gives each window's languages.  A text's language is the
one with the largest mean probability over its windows.  Byte embeddings are folded into
the filters, so a filter of width w is w tables of 256 rows.

The network is trained in numpy on a bounded sample (PER_LANG documents of each of the
MOST_LANGS most frequent languages, TRAIN_WINDOWS windows each; documented limits on fitting
only).

Defined results: a text that is null or has no letter (no code point of the Unicode
categories L) gets `und` with score 0.0; so does
every text when no labelled text was learned from; repeated rows are judged alike; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import encode

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
STRIDE = WINDOW - max(WIDTHS) + 1
PER_LANG = 400
MOST_LANGS = 500
TRAIN_WINDOWS = 6
WORDLIKE = re.compile(r"[^\W\d_]+")
SHAPE = "lang_pred string, score double"


def lettered(text: str | None) -> bool:
    """Whether there is a letter; what the pattern finds may also be numbers such as ½."""
    return any(c.isalpha() for m in WORDLIKE.finditer(text or "") for c in m[0])


def cut_windows(data: bytes) -> np.ndarray:
    """All windows of a text's bytes, A-Z lower-cased, padded with zero bytes."""
    data = data.lower()
    n = max(1, -(-(len(data) - WINDOW + STRIDE) // STRIDE))
    out = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::STRIDE]


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: list[np.ndarray]
    dense: np.ndarray
    shift: np.ndarray

    def pooled(self, x: np.ndarray, where: bool = False):
        """Max-pooled responses, and where each maximum lies if asked for."""
        most, at = [], []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
            n = x.shape[1] - w + 1
            r = table[0].take(x[:, :n], axis=0)
            for k in range(1, w):
                r += table[k].take(x[:, k : k + n], axis=0)
            if where:
                place = r.argmax(1)
                at.append(place)
                top = np.take_along_axis(r, place[:, None, :], 1)[:, 0, :]
            else:
                top = r.max(1)
            most.append(np.maximum(top + bias, 0))
        return np.concatenate(most, 1), at

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window, a bounded block of windows at a time."""
        out = []
        for k in range(0, len(x), 256):
            z = self.pooled(x[k : k + 256])[0] @ self.dense + self.shift
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        blocks = [cut_windows(encode(t)) if lettered(t) else None for t in texts]
        flat = [b for b in blocks if b is not None]
        if not flat or not self.langs:
            return [("und", 0.0)] * len(texts)
        sizes = [len(b) for b in flat]
        p = np.add.reduceat(self.chances(np.concatenate(flat)), np.cumsum([0, *sizes[:-1]]), axis=0)
        means = iter(p / np.array(sizes)[:, None])
        out = []
        for b in blocks:
            if b is None:
                out.append(("und", 0.0))
            else:
                m = next(means)
                out.append((self.langs[int(m.argmax())], float(min(1.0, m.max()))))
        return out


def train(rows: list[tuple[str, str]], epochs: int = 12, seed: int = 7) -> Network:
    """rows of (text, lang).  Adam on the cross-entropy of windows."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    f = len(WIDTHS) * FILTERS
    net = Network(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, (f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    if not langs:
        return net
    xs, ys = [], []
    for text, lang in rows:
        w = cut_windows(encode(text))
        if len(w) > TRAIN_WINDOWS:
            w = w[rng.choice(len(w), TRAIN_WINDOWS, replace=False)]
        xs.append(w)
        ys += [langs.index(lang)] * len(w)
    x, y = np.concatenate(xs), np.array(ys)
    share = np.bincount(y, minlength=len(langs)) / len(y)
    weight = (1 / np.maximum(share, 1e-9) / len(langs))[y]
    params = [*net.tables, *net.bias, net.dense, net.shift]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 128):
            i = order[k : k + 128]
            h, at = net.pooled(x[i], where=True)
            z = h @ net.dense + net.shift
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p *= (weight[i] / len(i))[:, None]
            p = p.astype(np.float32)
            back = (p @ net.dense.T) * (h > 0)
            grads_t, grads_b = [], []
            for g, (w, place) in enumerate(zip(WIDTHS, at, strict=True)):
                part = back[:, g * FILTERS : (g + 1) * FILTERS]
                grad = np.zeros_like(net.tables[g])
                cols = np.broadcast_to(np.arange(FILTERS), part.shape)
                for j in range(w):
                    byte = np.take_along_axis(x[i], place + j, 1)
                    np.add.at(grad[j], (byte, cols), part)
                grads_t.append(grad)
                grads_b.append(part.sum(0))
            grads = [*grads_t, *grads_b, h.T @ p, p.sum(0)]
            step += 1
            for q, gq, mq, vq in zip(params, grads, m, v, strict=True):
                mq += 0.1 * (gq - mq)
                vq += 0.001 * (gq * gq - vq)
                q -= 0.01 * (mq / (1 - 0.9**step)) / (np.sqrt(vq / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> Network:
    """From (doc_id, text, lang): at most per_lang documents of each of the most_langs most
    frequent languages, the first ones by a hash of doc_id.  A share of about twice as many
    is read for that, so what is collected has a bound whatever a language's size."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    langs = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not langs:
        return train([])
    known = docs.sparkSession.createDataFrame([(r[0], min(1.0, (2 * per_lang + 50) / max(1, r[1]))) for r in langs], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("place")
    drawn = usable.select("doc_id", "lang", place).join(F.broadcast(known), "lang").filter(F.col("place") < F.col("share") * (1 << 30))
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, place, doc_id in drawn.select("lang", "place", "doc_id").distinct().collect():
        found.setdefault(lang, []).append((place, doc_id))
    ids = sorted({doc_id for rows in found.values() for _, doc_id in sorted(rows)[:per_lang]})
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    texts = usable.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.*")
    return train([(r[1], r[2]) for r in sorted(texts.collect(), key=lambda r: r[0]) if lettered(r[1])])


def identify(net: Network, text: Column) -> Column:
    """A struct of SHAPE for each whole text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        values = texts.tolist()
        out = [r for k in range(0, len(values), 64) for r in net.predict(values[k : k + 64])]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return F.pandas_udf(run, SHAPE)(text)
