"""Versioned snapshots of a corpus: files, blocks and vectors as Parquet, a manifest, and
a pointer that is swapped when all of it is written."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import fnv64_bulk, fnv_bytes
from lodestone.operators import ask, chunk, providers, vectors
from lodestone.sources import files as tree

VERSION = 1
TABLES = ("files", "blocks", "vectors")
#: Snapshots up to this size are read whole when they are opened, to see damage in them.
VERIFY_BYTES = 1 << 30
#: Columns added after the first version, with what older snapshots get.
DEFAULTS = {"files": {"hash": "string"}, "blocks": {"hash": "string"}, "vectors": {}}


def directory(root: str, base: str | None = None) -> str:
    """Where the snapshots of a tree live: a readable name and a hash of its full path."""
    full = os.path.abspath(root)
    home = os.environ.get("HOME") or os.environ.get("USERPROFILE") or full
    base = base or os.environ.get("LODESTONE_HOME") or os.path.join(home, ".cache", "lodestone")
    name = re.sub(r"[^A-Za-z0-9._-]", "_", os.path.basename(full)) or "root"
    return os.path.join(base, f"{name}-{fnv_bytes(full.encode()):016x}")


@dataclass
class Snapshot:
    spark: SparkSession
    folder: str
    id: str
    manifest: dict

    def table(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.folder}/{self.id}/{name}")
        for column, kind in DEFAULTS[name].items():
            if column not in frame.columns:
                frame = frame.withColumn(column, F.lit(None).cast(kind))
        return frame


def fingerprint(files: DataFrame) -> DataFrame:
    """count xor the exclusive or of all content hashes (16 hex digits)."""
    low = F.conv(F.substring("hash", 9, 8), 16, 10).cast("long")
    high = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    a = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(high), F.lit(0)).alias("hi"), F.coalesce(F.bit_xor(low), F.lit(0)).alias("lo"))
    folded = F.col("lo").bitwiseXOR(F.col("n"))
    return a.select(F.lower(F.concat(F.lpad(F.hex("hi"), 8, "0"), F.lpad(F.hex(folded), 8, "0"))).alias("fingerprint"), F.col("n").alias("files"))


def manifest(files: DataFrame, blocks: DataFrame, vectors_: DataFrame | None, provider: str, dim: int) -> dict:
    """One row about a snapshot."""
    f = fingerprint(files).first()
    return {
        "version": VERSION,
        "provider": provider,
        "dim": dim,
        "fingerprint": f["fingerprint"],
        "files": f["files"],
        "blocks": blocks.count(),
        "vectors": 0 if vectors_ is None else vectors_.count(),
    }


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path or a URI) and the folder's path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))


def _write(folder: str, name: str, text: str) -> None:
    store, root = store_of(folder)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(text.encode())


def _read(folder: str, name: str) -> str:
    store, root = store_of(folder)
    with store.open_input_stream(f"{root}/{name}") as f:
        return f.read().decode()


def _bytes(folder: str) -> int:
    store, root = store_of(folder)
    return sum(x.size or 0 for x in store.get_file_info(fs.FileSelector(root, recursive=True)))


def save(spark: SparkSession, folder: str, files: DataFrame, blocks: DataFrame, vectors_: DataFrame, provider: str = "hash:256", dim: int = 256) -> Snapshot:
    """Writes a new snapshot and then swaps the pointer; readers see all of it or none."""
    new = uuid.uuid4().hex
    for name, frame in zip(TABLES, (files, blocks, vectors_), strict=True):
        frame.write.option("parquet.page.write-checksum.enabled", "true").parquet(f"{folder}/{new}/{name}")
    read = {name: spark.read.parquet(f"{folder}/{new}/{name}") for name in TABLES}
    made = manifest(read["files"], read["blocks"], read["vectors"], provider, dim)
    made["bytes"] = _bytes(f"{folder}/{new}")
    made["digest"] = digest(spark, f"{folder}/{new}") if made["bytes"] <= VERIFY_BYTES else None
    _write(folder, f"{new}/manifest.json", json.dumps(made))
    _write(folder, f"CURRENT.{new}", new)
    store, root = store_of(folder)
    store.move(f"{root}/CURRENT.{new}", f"{root}/CURRENT")
    return Snapshot(spark, folder, new, made)


def digest(spark: SparkSession, folder: str) -> str:
    """One digest of the names and contents of the files under a folder."""
    each = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    named = each.select(F.concat(F.element_at(F.split("path", "/", -1), -1), F.lit(" "), F.md5("content")).alias("x"))
    return named.agg(F.md5(F.array_join(F.sort_array(F.collect_list("x")), "\n"))).first()[0]


def whole(snapshot: Snapshot, verify: bool | None = None) -> bool:
    """Whether every table has the rows that the manifest names, and a small snapshot every
    byte.  Of a larger one, `verify` reads all pages and holds them against their checksums."""
    made = snapshot.manifest
    if any(name in made and snapshot.table(name).count() != made[name] for name in TABLES):
        return False
    if made.get("digest"):
        return verify is False or digest(snapshot.spark, f"{snapshot.folder}/{snapshot.id}") == made["digest"]
    if verify:
        for name in TABLES:
            checked = snapshot.spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(f"{snapshot.folder}/{snapshot.id}/{name}")
            checked.write.format("noop").mode("overwrite").save()
    return True


def load(spark: SparkSession, folder: str, verify: bool | None = None) -> Snapshot | None:
    """The current snapshot; None if there is none, it is damaged, or of a newer version."""
    try:
        at = _read(folder, "CURRENT").strip()
        made = json.loads(_read(folder, f"{at}/manifest.json"))
        if made["version"] > VERSION:
            return None
        snapshot = Snapshot(spark, folder, at, made)
        return snapshot if whole(snapshot, verify) else None
    except Exception:  # whatever is wrong with it, a snapshot can be built again
        return None


def stat(folder: str) -> dict | None:
    """path, bytes and age in seconds of the current snapshot."""
    try:
        at = f"{folder}/{_read(folder, 'CURRENT').strip()}"
        store, root = store_of(folder)
        changed = store.get_file_info(f"{root}/CURRENT").mtime.timestamp()
        return {"path": at, "bytes": _bytes(at), "age_seconds": int(time.time() - changed)}
    except OSError:
        return None


def scan(spark: SparkSession, root: str, own: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """The files of a tree, or of some of its paths."""
    tree.register(spark)
    reader = spark.read.format("file_tree").option("path", root).option("own", json.dumps(list(own)))
    return (reader if only is None else reader.option("only", json.dumps(only))).load()


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", fnv64_bulk("content"))


def refresh_diff(old: DataFrame, new: DataFrame, key: str = "rel") -> DataFrame:
    """key and status (added, removed, modified, same) by (mtime_ns, len)."""
    a = old.select(F.col(key).alias("_k"), F.col("mtime_ns").alias("_m"), F.col("len").alias("_l"))
    joined = new.select(key, "mtime_ns", "len").join(a, F.col(key) == F.col("_k"), "full_outer")
    same = F.col("mtime_ns").eqNullSafe(F.col("_m")) & F.col("len").eqNullSafe(F.col("_l"))
    status = F.when(F.col("_k").isNull(), "added").when(F.col(key).isNull(), "removed").when(same, "same").otherwise("modified")
    return joined.select(F.coalesce(key, "_k").alias(key), status.alias("status"))


def upsert(old: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "rel") -> DataFrame:
    """old with the rows of `changed` in place of those of equal key, without `removed`."""
    kept = old.join(changed.select(key).distinct(), key, "left_anti")
    if removed is not None:
        kept = kept.join(removed.select(key), key, "left_anti")
    return kept.select(old.columns).unionByName(changed.select(old.columns))


NO_VECTORS = "hash string, embedding array<float>"


def build(spark: SparkSession, root: str, folder: str, dim: int = 256, provider: providers.Provider | None = None) -> Snapshot:
    """A snapshot of a tree.  Vectors of the offline provider come with it; those of a
    service are made when they are first asked for."""
    provider = provider or providers.Provider(dim=dim)
    files = with_hash(scan(spark, root, (folder,)))
    blocks = chunk.hashed(chunk.blocks(files))
    none = spark.createDataFrame([], NO_VECTORS)
    found = _offline(blocks, none, provider) if provider.kind == "hash" else none
    return save(spark, folder, files, blocks, found, provider.identity, provider.dim)


def _offline(blocks: DataFrame, held: DataFrame, provider: providers.Provider) -> DataFrame:
    return vectors.missing(blocks, held.select("hash")).select("hash", vectors.hash_embed(F.col("text"), provider.dim).alias("embedding"))


def refresh(snapshot: Snapshot, root: str, only: list[str] | None = None) -> tuple[Snapshot, int]:
    """The snapshot brought up to date, and how many files changed; with `only`, paths that
    changed or went, nothing else is looked at.

    Only changed files are cut into blocks, and only new contents get vectors; vectors of
    contents that are gone go too, and a removal alone is a change as well."""
    spark, folder = snapshot.spark, snapshot.folder
    now = scan(spark, root, (folder,), only)
    old = snapshot.table("files")
    known = old if only is None else old.join(F.broadcast(spark.createDataFrame([(r,) for r in only], "rel string")), "rel", "left_semi")
    diff = refresh_diff(known, now).filter("status != 'same'").cache()
    n = diff.count()
    if not n:
        return snapshot, 0
    changed = with_hash(now.join(diff.filter("status != 'removed'").select("rel"), "rel", "left_semi"))
    removed = diff.filter("status = 'removed'").select("rel")
    files = upsert(old, changed, removed)
    provider = providers.of_identity(snapshot.manifest["provider"])
    if files.groupBy("file_id").count().filter("count > 1").isEmpty():
        fresh = chunk.hashed(chunk.blocks(changed))
        gone = diff.select("rel")
        blocks = snapshot.table("blocks").join(gone, "rel", "left_anti").unionByName(fresh)
        kept = vectors.collect_garbage(snapshot.table("vectors"), blocks)
        if provider:
            kept = kept.unionByName(_offline(fresh, snapshot.table("vectors"), provider))
        out = save(spark, folder, files, blocks, kept, snapshot.manifest["provider"], snapshot.manifest["dim"])
    else:  # a new path has the number of an old one, so all are dealt anew
        out = build(spark, root, folder, provider=provider)
    diff.unpersist()
    return out, n


def ensure(snapshot: Snapshot, provider: providers.Provider) -> Snapshot:
    """The snapshot with a vector for each content of its blocks.  Vectors of another
    provider are dropped first, so that spaces never mix; contents that have one of this
    provider aren't sent again."""
    spark, folder = snapshot.spark, snapshot.folder
    blocks, held = snapshot.table("blocks"), snapshot.table("vectors")
    same = snapshot.manifest["provider"] == provider.identity
    if not same:
        held = spark.createDataFrame([], NO_VECTORS)
    lacking = vectors.missing(blocks, held.select("hash"))
    if same and lacking.isEmpty():
        return snapshot
    made = _offline(blocks, held, provider) if provider.kind == "hash" else ask.missing_made(blocks, held, provider)
    return save(spark, folder, snapshot.table("files"), blocks, held.unionByName(made), provider.identity, provider.dim)


def open_or_build(spark: SparkSession, root: str, folder: str | None = None, provider: providers.Provider | None = None) -> Snapshot:
    folder = folder or directory(root)
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    found = load(spark, folder)
    return build(spark, root, folder, provider=provider) if found is None else refresh(found, root)[0]
