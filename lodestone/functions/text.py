"""Column expressions for text: lines, blanks, byte trigrams, occurrences, paths, FNV-1a."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A line of Unicode white space only.
BLANK = r"(?U)^\s*$"
MASK32 = 0xFFFFFFFF


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it.

    An expression that a lambda mentions is computed again for every element; a lambda's
    own argument isn't."""
    return F.transform(F.array(value), body)[0]


def lines(content: Column) -> Column:
    """Lines without their ends, CR LF counting as one end; no empty line after the last."""
    parts = F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return bind(parts, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def occurrences(text: Column, query: str) -> Column:
    """How often a query occurs, in any letter case, without overlap."""
    q = F.lower(F.lit(query))
    low = F.lower(text)
    return ((F.char_length(low) - F.char_length(F.replace(low, q, F.lit("")))) / F.char_length(q)).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct three-byte windows of the lower-cased UTF-8 text, as six hex digits."""
    return bind(
        F.lower(text).cast("binary"),
        lambda b: F.when(
            F.octet_length(b) >= 3,
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.octet_length(b) - 2), lambda i: F.hex(F.substring(b, i, F.lit(3))))),
        ).otherwise(F.array().cast("array<string>")),
    )


def trigrams_of(query: str) -> list[str]:
    data = query.lower().encode()
    return sorted({data[i : i + 3].hex().upper() for i in range(len(data) - 2)})


def normalize_path(path: Column) -> Column:
    """A relative path without `.`, `..` and empty parts; `..` above the root is dropped."""
    empty = F.array().cast("array<string>")

    def step(seen: Column, part: Column) -> Column:
        shorter = F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        return F.when(part.isin("", "."), seen).when(part == "..", shorter).otherwise(F.concat(seen, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/", -1), empty, step), "/")


def fnv64(data: Column) -> Column:
    """FNV-1a of bytes as 16 hex digits.

    Two 32-bit halves, so that no product overflows a signed 64-bit number: the prime is
    2^40 + 435, hence (h * prime) mod 2^64 needs h * 435 and the low half shifted by 8."""
    binary = data.cast("binary")

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(binary, i, F.lit(1))), 16, 10).cast("long")
        low = h["lo"].bitwiseXOR(byte)
        product = low * 435
        carried = h["hi"] * 435 + F.shiftleft(low, 8) + F.shiftright(product, 32)
        return F.struct(carried.bitwiseAND(F.lit(MASK32)).alias("hi"), product.bitwiseAND(F.lit(MASK32)).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    places = F.when(F.octet_length(binary) > 0, F.sequence(F.lit(1), F.octet_length(binary))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def fnv_bytes(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv_many(texts: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once: all advance a byte at a time, longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    if not texts:
        return out
    size = np.array([len(texts[i]) for i in order])
    flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8).astype(np.uint64)
    first = np.cumsum(size) - size
    h = out.copy()
    for k in range(int(size[0])):
        n = int(np.searchsorted(-size, -k, side="left"))
        h[:n] = (h[:n] ^ flat[first[:n] + k]) * np.uint64(0x100000001B3)
    out[np.array(order)] = h
    return out


def fnv64_bulk(text: Column | str) -> Column:
    """fnv64 of texts (null: empty), for large inputs."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{int(h):016x}" for h in fnv_many([(t or "").encode() for t in texts])])

    return F.pandas_udf(run, "string")(text)
