"""Quality by weak supervision: rules vote good, bad or abstain, expectation-maximisation
estimates how often each rule is right, and a document stays when its posterior
probability of being good reaches a threshold.

Rules are strict, so many good documents get a bad vote somewhere; how much a vote weighs
follows from how the rule votes where the others agree, not from a setting.  Rules of one
GROUP look at the same fault and so fail together, and faults differ: the latent class is
good, or bad by one of the groups.  Within a class votes are independent; across the bad
classes they are not, which is how correlated rules are modelled.

A pass counts vote patterns (at most 3^rules rows, whatever the corpus), the driver runs
EM on these counts, and the posterior of each pattern is applied.  Nothing is sampled.
Defined results: null and empty texts have zero counts and fail the base rule (fewer than
50 words); rules without enough to go by (a single line, fewer than MANY words) abstain;
repeated rows are judged alike, each on its own; an empty table gives an empty table;
columns of the input keep their names, and a clash with the one that is added raises an
error (`kept_by` picks a free name itself).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import cut, encode

SYMBOL_BYTES = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "dup_lines", "repeats", "shouting", "exclaims", "word_length", "alphabetic", "spread")
GROUPS = (("symbols", "alphabetic"), ("dup_lines", "repeats", "spread"), ("shouting", "exclaims"), ("word_length",))
#: Prior chances of a good vote, an abstention and a bad vote: of any rule for a good
#: document, of a bad class's own group of rules, and of the other rules for a bad
#: document.  They count as much as PRIOR_SHARE of the corpus.
GOOD, OWN, OTHER = (0.85, 0.1, 0.05), (0.1, 0.2, 0.7), (0.7, 0.15, 0.15)
PRIOR_SHARE = 0.02
MANY = 20
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, votes string"
SPACES = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))


def repeated(ids: np.ndarray) -> np.ndarray:
    """Which positions lie in a three-word window that occurs at least twice."""
    n = len(ids)
    covered = np.zeros(n, bool)
    if n < 4:
        return covered
    m = int(ids.max()) + 1
    a, b = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(b[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return covered


def vote(good: bool, bad: bool) -> str:
    return "-" if bad else "+" if good else "0"


def judge(text: str | None) -> tuple:
    """The counts of one whole text, whether the base rule fails it, and its votes."""
    data = encode(text)
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, sum(data.count(b) for b in SYMBOL_BYTES), 0, 0, True, "0" * len(RULES)
    solid = data.translate(None, SPACES)
    chars = len(solid.translate(None, CONTINUATION))
    symbols = len(data) - len(data.translate(None, SYMBOL_BYTES))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    numbers = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, n)
    again = int(repeated(numbers).sum())
    upper = sum(w[:2].isupper() and len(w) > 1 for w in ids)
    exclaims = data.count(b"!")
    plain = np.fromiter((w.strip(b".,;:!?'\"()-").isalpha() or not w.isascii() for w in ids), bool, len(ids))
    alphabetic = int(np.bincount(numbers, minlength=len(ids))[plain].sum())
    mean = chars / n
    many = n >= MANY
    votes = "".join((
        vote(symbols <= 0.01 * chars, symbols > 0.03 * chars),
        vote(lines > 1 and not dup, dup > 0),
        vote(many and again <= 0.1 * n, again > 0.35 * n),
        vote(upper <= 0.1 * len(ids), many and upper > 0.25 * len(ids)),
        vote(exclaims <= 0.005 * n, many and exclaims > 0.02 * n),
        vote(many and 3.5 <= mean <= 7.5, many and (mean < 3 or mean > 9)),
        vote(alphabetic > 0.9 * n, alphabetic < 0.8 * n),
        vote(many and len(ids) > 0.35 * n, many and len(ids) < 0.25 * n),
    ))
    return n, chars, symbols, dup, again, n < 50 or 100 * again > 50 * n, votes


def evidence(text: Column) -> Column:
    """A struct of SCHEMA for each text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t) for t in texts], columns=[*COUNTS, "base_failed", "votes"])

    return F.pandas_udf(run, SCHEMA)(text)


def fit(patterns: dict[str, int], rounds: int = 300) -> dict[str, float]:
    """Posterior probability of being good for each vote pattern.

    In each class every rule has its own chances of voting good, abstaining or voting bad
    (its accuracy on that class), which EM estimates from the counts and the prior, as it
    does the shares of the classes."""
    if not patterns:
        return {}
    names = sorted(patterns)
    cast = np.array([[["+0-".index(c) == k for k in range(3)] for c in p] for p in names], float)  # pattern, rule, outcome
    n = np.array([patterns[p] for p in names], float)
    belief = np.empty((1 + len(GROUPS), len(RULES), 3))
    belief[0], belief[1:] = GOOD, OTHER
    for k, group in enumerate(GROUPS):
        belief[1 + k, [RULES.index(r) for r in group]] = OWN
    chances, classes = belief, len(belief)
    prior = np.append(0.8, np.full(classes - 1, 0.2 / (classes - 1)))
    for _ in range(rounds):
        logs = np.log(prior) + np.einsum("pro,cro->pc", cast, np.log(chances))
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        seen = np.einsum("pc,pro->cro", n[:, None] * post, cast) + PRIOR_SHARE * n.sum() * belief
        chances = seen / seen.sum(2, keepdims=True)
        prior = (n @ post + 1e-3 * n.sum()) / (n.sum() * (1 + 1e-3 * classes))
    return {p: float(x) for p, x in zip(names, post[:, 0], strict=True)}


def free(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it a new one."""
    while name in docs.columns:
        name = "_" + name
    return name


def posteriors(judged: DataFrame, column: str) -> dict[str, float]:
    patterns = judged.groupBy(F.col(column)["votes"]).count()
    return fit({r[0]: r[1] for r in patterns.collect()})


def decided(judged: DataFrame, column: str, posterior: dict[str, float], threshold: float) -> DataFrame:
    """judged with posterior and kept in the struct `column`."""
    names = [free(judged, n) for n in ("votes", "posterior")]
    # At most 3^rules rows, so the broadcast has a proven bound.
    known = judged.sparkSession.createDataFrame([(v, round(p, 6)) for v, p in posterior.items()], f"`{names[0]}` string, `{names[1]}` double")
    q, p = F.col(column), F.col(names[1])
    joined = judged.join(F.broadcast(known), q["votes"] == F.col(names[0]), "left")
    return joined.withColumn(column, q.withField("posterior", p).withField("kept", ~q["base_failed"] & (p >= threshold))).select(judged.columns)


def assess(docs: DataFrame, text: str = "text", threshold: float = 0.5, into: str = "_quality") -> DataFrame:
    """docs with one more column: counts, base_failed, votes, posterior, kept.  Texts are
    read twice, for the patterns and for the answer, rather than written in between."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    judged = docs.withColumn(into, evidence(F.col(text)))
    counted = docs.select(evidence(F.col(text)).alias(into))
    return decided(judged, into, posteriors(counted, into), threshold)


def judged_ids(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and the struct `_quality` of each row of (doc_id, text): what the rules find
    is written once, without the texts."""
    rows = cut(docs.select("doc_id", evidence(F.col("text")).alias("_quality")))
    return decided(rows, "_quality", posteriors(rows, "_quality"), threshold)


def kept_by(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that stay, with the columns of docs."""
    into = free(docs, "_quality")
    return assess(docs, threshold=threshold, into=into).filter(F.col(into)["kept"]).select(docs.columns)
