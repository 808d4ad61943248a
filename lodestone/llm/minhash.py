"""Near-duplicate groups by b-bit MinHash.

1. One pass hashes each whole text into its set of word shingles, an order-free 128-bit
   fingerprint of the set, the minima of its hashes under many permutations, their band
   keys, and a signature of the minima's low eight bits packed into 64-bit integers.
2. Equal sets become one node, so exact copies never meet in a join.
3. Nodes that share a band key are candidates.  In each band bucket pivots meet the
   others: the smallest document, and in a bucket of more than FEW two random ones, which
   joins nearly all of a large group in linear work.  A count of differing bytes in the
   packed signatures, corrected for chance collisions, discards pairs far below the
   threshold; the rest is confirmed on full sets, and links give components.
4. Buckets that still hold several components are cut into tiles: the members outside the
   largest part meet one another and all members inside, tile against tile, so that a hot
   bucket spreads over many tasks of bounded size.  Signatures are compared first, in
   blocks; members with a partner take their full sets to a second, exact comparison, and
   a task returns a spanning forest of its links.  Members already in one component need
   no further links, so no pair within a group of copies is expanded, and no link that
   would join two components is lost beyond the miss rates of bands and estimate (each
   below 1e-6 for a pair at the threshold).

Counts and minima of buckets, neighbours and components are aggregates with partial sums,
so a key that holds a third of all rows is combined before it is exchanged; the joins back
to such keys have one row a key on the other side, which adaptive execution splits.

Defined results: null, empty and blank texts have no shingles, link with nothing and stand
alone; texts of fewer than `width` words are one shingle; null doc_ids take part and sort
last (a group of only null ids has a null component); rows with equal doc_id are separate
rows that may link; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import Vocabulary, cut, mix64, windows, words_of

WIDTH = 5
FEW = 8
#: Links that one task joins to a forest before components are sought among all.
FOREST = 200_000
#: Members of a tile, each weighing 1 and a part for a long text, so that two tiles with
#: their full sets stay within some 2 * TILE * LONG * 8 bytes.
TILE, LONG = 512, 2048
#: A pair at the threshold fails the signature estimate with at most this probability.
MISSED = 1e-6
LAST = (1 << 63) - 1
ROW = "id long, text_hash long, n long, fp binary, bands array<long>, sig array<long>"
MEMBER = "bucket long, x int, y int, side int, band int, node binary, component long, n long, keys array<int>, sig array<long>"


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows of a band): a pair at the threshold is missed with (1 - t^rows)^bands."""
    return (26, 5) if percent >= 85 else (28, 4)


def most_differing(percent: int) -> int:
    """In how many minima a pair may differ and still be held against full sets: the least
    number that a pair at the threshold, given one shared band, exceeds with at most MISSED
    (equal low bytes of different minima only lower what is seen to differ)."""
    bands, rows = bands_for(percent)
    free, apart = (bands - 1) * rows, 1 - percent / 100
    tail = 1.0
    for k in range(free + 1):
        tail -= math.comb(free, k) * apart**k * (1 - apart) ** (free - k)
        if tail <= MISSED:
            return k
    return free


def permutations(k: int) -> np.ndarray:
    return mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: list[bytes], vocabulary: Vocabulary, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = vocabulary.hashed(words)
    if len(words) < width:
        return windows(np.append(hashes, np.uint64(len(words))), len(words) + 1)
    return np.unique(windows(hashes, width))


def fingerprint(values: np.ndarray) -> bytes:
    a, b = values.sum(dtype=np.uint64), mix64(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def minima(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Of the whole set under each permutation, in blocks that stay in the cache."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 512):
        np.minimum(best, (values[k : k + 512, None] * factors[None, :]).min(0), out=best)
    return best


def identified(docs: DataFrame) -> list[Column]:
    """What tells rows apart: doc_id (null last) and a hash of the text."""
    return [F.coalesce(docs["doc_id"], F.lit(LAST)).alias("id"), F.xxhash64(docs["text"]).alias("text_hash")]


def sketch(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """ROW for each row of (doc_id, text)."""
    bands, rows = bands_for(percent)

    def run(batches):
        vocabulary, factors = Vocabulary(), permutations(bands * rows)
        lanes = -(-bands * rows // 8) * 8
        for batch in batches:
            out = []
            for doc_id, text_hash, text in zip(batch["id"], batch["text_hash"], batch["text"], strict=True):
                s = shingles(words_of(text), vocabulary, width)
                if not len(s):
                    out.append((doc_id, text_hash, 0, b"", [], []))
                    continue
                low = mix64(minima(s, factors))
                key = windows_of_bands(low.reshape(bands, rows))
                packed = np.zeros(lanes, np.uint8)
                packed[: len(low)] = (low & np.uint64(255)).astype(np.uint8)
                out.append((doc_id, text_hash, len(s), fingerprint(s), key.view(np.int64), packed.view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "text_hash", "n", "fp", "bands", "sig"])

    return docs.select(*identified(docs), "text").mapInPandas(run, ROW)


def windows_of_bands(low: np.ndarray) -> np.ndarray:
    key = np.arange(len(low), dtype=np.uint64) + np.uint64(1)
    for k in range(low.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ low[:, k])
    return key


def differing(a: Column, b: Column, lanes: int) -> Column:
    """In how many bytes two packed signatures differ: fold the bits of each byte of the
    exclusive or onto its lowest one, and count bits.  Written out lane by lane, as
    compiled code evaluates that some fifty times faster than a lambda over arrays."""
    total = None
    for k in range(lanes):
        d = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        n = F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
        total = n if total is None else total + n
    return total


def promising(a: str, b: str, percent: int) -> Column:
    """Sizes allow the threshold, and so does the number of minima that differ."""
    bands, rows = bands_for(percent)
    apart = differing(F.col(f"{a}.sig"), F.col(f"{b}.sig"), -(-bands * rows // 8))
    low, high = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (100 * low >= percent * high) & (apart <= most_differing(percent))


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) with b the least node that a is joined to by the edges of a partition."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].map(bytes), batch["b"].map(bytes), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    rows = [(x, y) for x in list(root) if (y := find(x)) != x]
    yield pd.DataFrame(rows, columns=["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of all ends of the written (a, b).

    Tasks of FOREST edges or so first make forests of theirs.  Where there are several
    tasks, alternating large and small stars go on until every edge ends at a root.  The
    least neighbour of a node is an aggregate with partial minima."""
    tasks = max(1, -(-edges.count() // FOREST))
    e = cut(edges.select("a", "b").coalesce(tasks).mapInPandas(forest, "a binary, b binary"))
    while tasks > 1 and not e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
        e = cut(starred(e))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def starred(e: DataFrame) -> DataFrame:
    """The edges after a large and a small star."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b"))
    return small.filter(F.col("a") != F.col("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) whose full sets reach the threshold."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    with_a = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")

    def run(sa: pd.Series, sb: pd.Series) -> pd.Series:
        def linked(p: np.ndarray, q: np.ndarray) -> bool:
            both = len(np.intersect1d(p, q, assume_unique=True))
            return 100 * both >= percent * (len(p) + len(q) - both)

        return pd.Series([linked(x, y) for x, y in zip(sa, sb, strict=True)], dtype=bool)

    return with_a.filter(F.pandas_udf(run, "boolean")("sa", "sb")).select("a", "b")


def pivoted(shared: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the pivots of each bucket and its other members.  Random pivots are
    the same for buckets of the same members, of which there are many."""
    least = [F.min(F.struct(order.alias("o"), "node")).alias(f"p{k}") for k, order in enumerate((F.col("id"), F.xxhash64("node", F.lit(1)), F.xxhash64("node", F.lit(2))))]
    pivots = shared.groupBy("bucket").agg(F.count("*").alias("c"), *least)
    chosen = F.when(F.col("c") > FEW, F.array("p0.node", "p1.node", "p2.node")).otherwise(F.array("p0.node"))
    pairs = shared.join(pivots.select("bucket", chosen.alias("pivots")), "bucket").select("node", F.explode("pivots").alias("pivot"))
    pairs = pairs.filter("node != pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    x, y = (sketches.select("node", "n", "sig").alias(s) for s in "xy")
    near = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(promising("x", "y", percent))
    return confirmed(near.select("a", "b"), sets, percent)


def tiled(shared: DataFrame, sketches: DataFrame, label: DataFrame) -> DataFrame:
    """MEMBER rows of the buckets with several components, for each pair of tiles (x, y) a
    member takes part in.  Members outside the component of the bucket's first document
    make tiles 0, 1, ..., those inside tiles -1, -2, ...; tiles inside never meet."""
    named = shared.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    core = named.groupBy("bucket").agg(F.min(F.struct("id", "node", "component"))["component"].alias("core"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    marked = named.join(core.filter("lo != hi").select("bucket", "core"), "bucket").withColumn("out", F.col("component") != F.col("core"))
    weight = 1 + F.col("n") / LONG

    def tiles(out: Column) -> Column:
        return F.ceil(F.sum(F.when(out, weight).otherwise(0)) / TILE).cast("int")

    sizes = marked.groupBy("bucket").agg(tiles(F.col("out")).alias("outer"), tiles(~F.col("out")).alias("inner"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
    # Tile 0 to outer - 1 for members outside, with each other such tile and each inside.
    each = F.sequence(F.lit(0), F.col("outer") - 1)
    inside = F.transform(F.sequence(F.lit(-1), -F.col("inner"), F.lit(-1)), lambda j: F.struct(F.col("own").alias("x"), j.alias("y"), F.lit(0).alias("side")))
    others = F.transform(
        F.filter(each, lambda j: j != F.col("own")),
        lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y"), (j < F.col("own")).cast("int").alias("side")),
    )
    meets = F.transform(each, lambda j: F.struct(j.alias("x"), (-1 - F.col("own")).alias("y"), F.lit(1).alias("side")))
    dealt = marked.join(sizes, "bucket").withColumn("own", own).withColumn("t", F.explode(F.when(F.col("out"), F.concat(inside, others)).otherwise(meets)))
    keys = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("keys")
    rows = dealt.select("bucket", "t.*", "band", "node", "n", F.xxhash64("component").alias("component")).join(sketches.select("node", keys, "sig"), "node")
    return rows.select(*[c.split()[0] for c in MEMBER.split(", ")])


def gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames of whole tile pairs, with where each begins and ends."""
    held = None
    for batch in batches:
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = frame[["bucket", "x", "y"]].to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if len(edges):
            at = [0, *edges.tolist()]
            yield frame.iloc[: at[-1]], list(zip(at[:-1], at[1:], strict=True))
            held = frame.iloc[at[-1] :].reset_index(drop=True)
        else:
            held = frame
    if held is not None and len(held):
        yield held, [(0, len(held))]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bytes each row of a differs from each of b."""
    if len(a) * len(b) < 4096:
        return (a[:, None, :] != b[None, :, :]).sum(2)
    out = np.zeros((len(a), len(b)), np.uint8)
    for p, q in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += p[:, None] != q[None, :]
    return out


class Members:
    """The columns of a frame of MEMBER rows that decide which pairs are candidates."""

    def __init__(self, frame: pd.DataFrame, percent: int):
        self.percent, self.most = percent, most_differing(percent)
        self.n, self.component = frame["n"].to_numpy(), frame["component"].to_numpy()
        self.side, self.y, self.band = (frame[c].to_numpy() for c in ("side", "y", "band"))
        self.keys = np.vstack(frame["keys"].to_numpy())
        self.sig = np.ascontiguousarray(np.vstack(frame["sig"].to_numpy())).view(np.uint8)

    def candidates(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a tile pair that the estimate and sizes allow, in different components,
        in the first bucket that both are in.  A tile meets itself beside tile -1."""
        a = start + np.flatnonzero(self.side[start:end] == 0)
        b = start + np.flatnonzero(self.side[start:end] == 1)
        if self.y[start] == -1:
            b = np.concatenate([b, a])
        n, m = self.n[a][:, None], self.n[b][None, :]
        ok = (self.component[a][:, None] != self.component[b][None, :]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
        if not ok.any():
            return a[:0], b[:0]
        p, q = np.nonzero(ok & (apart(self.sig[a], self.sig[b]) <= self.most))
        p, q = a[p], b[q]
        once = (self.side[q] == 1) | (p < q)
        p, q = p[once], q[once]
        first = (self.keys[p] == self.keys[q]).argmax(1) == self.band[p]
        return p[first], q[first]


def links_of(members: Members, sets: list[np.ndarray], start: int, end: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a tile pair, on full sets."""
    p, q = members.candidates(start, end)
    if not len(p):
        return []
    used = np.unique(np.concatenate([p, q]))
    _, flat = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    ids = dict(zip(used.tolist(), np.split(flat, np.cumsum([len(sets[i]) for i in used])[:-1]), strict=True))
    flags = np.zeros(int(flat.max()) + 1, bool)
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]
    for at in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
        i = int(p[at[0]])
        flags[ids[i]] = True
        for j in q[at].tolist():
            if find(i) != find(j):
                both = int(np.count_nonzero(flags[ids[j]]))
                if 100 * both >= members.percent * (len(ids[i]) + len(ids[j]) - both):
                    root[find(j)] = find(i)
                    out.append((i, j))
        flags[ids[i]] = False
    return out


def remaining(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket in different components, enough to join them."""

    def near(batches):
        for frame, edges in groups(batches):
            members, kept = Members(frame, percent), np.zeros(len(frame), bool)
            for start, end in edges:
                p, q = members.candidates(start, end)
                kept[p] = kept[q] = True
            yield frame[kept]

    def linked(batches):
        for frame, edges in groups(batches):
            members, found = Members(frame, percent), []
            shingle_sets = frame["shingles"].tolist()
            for start, end in edges:
                found += links_of(members, shingle_sets, start, end)
            node = frame["node"].to_numpy()
            yield pd.DataFrame([(min(node[i], node[j]), max(node[i], node[j])) for i, j in found], columns=["a", "b"])

    close = cut(gathered(tiles).mapInPandas(near, MEMBER))
    return gathered(close.join(sets, "node")).mapInPandas(linked, "a binary, b binary").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the texts that stand for them."""

    def run(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            out = []
            for fp, text in zip(batch["node"], batch["text"], strict=True):
                s = shingles(words_of(text), vocabulary, width)
                if fingerprint(s) == bytes(fp):
                    out.append((fp, s.view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "shingles"])

    picked = docs.select(*identified(docs), "text").join(wanted, ["id", "text_hash"]).select("node", "text")
    made = picked.mapInPandas(run, "node binary, shingles array<long>")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def grouped(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """id (doc_id, null as LAST), text_hash, n and, where there are shingles, `low`: the
    (id, text_hash) that stands for the group, of each row of (doc_id, text)."""
    rows = cut(sketch(docs, percent, width))
    solid = rows.filter("n > 0")
    first = F.min(F.struct("id", "text_hash")).alias("first")
    nodes = cut(solid.groupBy(F.col("fp").alias("node")).agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    member = nodes.select("node", F.col("first.id").alias("id"), "n", F.posexplode("bands").alias("band", "bucket"))
    several = member.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    shared = cut(member.join(several, "bucket"))
    sketches = cut(nodes.join(shared.select("node"), "node", "left_semi"))
    sets = cut(full_sets(docs, sketches.select("first.*", "node"), width))
    links = cut(pivoted(shared, sketches, sets, percent))
    label = cut(connected(links))
    more = cut(remaining(tiled(shared, sketches, label), sets, percent))
    if not more.isEmpty():
        label = cut(connected(cut(more.union(label.filter("node != component").toDF("a", "b")))))
    chosen = nodes.select("node", "first")
    linked = label.join(sketches.select("node", "first"), "node")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    chosen = chosen.join(linked.join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "first").alias("first"))
    out = solid.select("id", "text_hash", "n", F.col("fp").alias("node")).join(chosen, "node").select("id", "text_hash", "n", F.col("first").alias("low"))
    blank = rows.filter("n = 0").select("id", "text_hash", "n", F.lit(None).cast("struct<id:bigint,text_hash:bigint>").alias("low"))
    return out.unionByName(blank)


def components(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of (doc_id, text)."""
    out = grouped(docs, percent, width).withColumn("low", F.coalesce("low.id", "id"))
    named = [F.when(F.col(c) != LAST, F.col(c)).alias(to) for c, to in (("id", "doc_id"), ("low", "component_id"))]
    return out.select(named[0], F.col("n").alias("n_shingles"), named[1], (F.col("id") == F.col("low")).alias("kept"))


def distinct_documents(docs: DataFrame, percent: int) -> DataFrame:
    """docs without all but one row of each group: the one of the least doc_id (null last),
    then of the least text hash, and one of rows equal in both; rows without any word stay."""
    # Names no column of docs has, so that other columns pass through whatever they are.
    i, h, r = (next(n for k in range(len(docs.columns) + 1) if (n := f"_{c}{k}") not in docs.columns) for c in "ihr")
    found = grouped(docs.select("doc_id", "text"), percent)
    gone = cut(found.filter((F.col("low.id") != F.col("id")) | (F.col("low.text_hash") != F.col("text_hash"))).select(F.col("id").alias(i), F.col("text_hash").alias(h)).distinct())
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(identified(docs), (i, h), strict=True)])
    kept = keyed.join(gone, [i, h], "left_anti")
    again = cut(found.filter("n > 0").groupBy("id", "text_hash").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("id").alias(i), F.col("text_hash").alias(h)))
    if not again.isEmpty():
        one = kept.join(again, [i, h], "left_semi").dropDuplicates([i, h])
        kept = kept.join(again, [i, h], "left_anti").unionByName(one)
    return kept.select(docs.columns)
