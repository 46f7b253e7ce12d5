"""Token ids in binary shards with keyed access through a minimal perfect hash.

A store is a folder of Parquet tables, written and read by Spark so that any
file system works. ``payload``: a folder for each shard, in it one row per block
of documents, documents in ascending order of their key over (shard, block);
``ids`` are the raw ids, little-endian, 2 or 4 bytes each by the vocabulary's
size. ``index``: one row per bucket of keys (a bucket is a hash of the key), in
folders of some buckets each, with the bytes of a minimal perfect hash over the
bucket's keys and, in slot order, a 32-bit fingerprint, the place (shard, block,
first id), the number of ids and the copies of each key. ``meta`` holds the
numbers of buckets and folders. Every block and every bucket is a page of its
own, so the lookup of a key opens the index file of its folder and the payload
file of its shard, and reads one bucket and one block of them, however many keys
there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.llm.common import map_batches, some, utf8
from quillframe.llm.encode import RUN_CHARS, Encoder, encoder, texts_of
from quillframe.llm.mph import MinimalPerfectHash, key_hashes

#: Ids in a block of the payload; a longer document is a block of its own.
BLOCK_IDS = 1 << 19
#: Keys in a bucket of the index, about.
BUCKET_KEYS = 20_000
#: Folders of the index, at most; more buckets share them.
FOLDERS = 4096
#: Keys asked for that are looked up by reading only their buckets and blocks; more of them are joined with the whole tables.
FEW = 1000

PAYLOAD = "shard int, block int, n_ids long, width int, keys array<string>, ats array<long>, counts array<long>, ids binary"
PLACES = "key string, shard int, block int, at long, n_tokens long, ids_crc32 long"
INDEX = "folder int, bucket long, n_keys long, hash binary, prints binary, shards binary, blocks binary, ats binary, sizes binary, copies binary"
META = "buckets long, folders int"
FOUND = "key string, shard int, block int, at long, n_tokens long, copies long"
#: Every row is a page, so that one of them can be read by itself.
PAGES = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.row.count.limit": "1"}


def _block(shard: int, block: int, width: int, keys: list, ids: list[bytes]) -> pa.RecordBatch:
    counts = [len(x) // width for x in ids]
    ats = np.concatenate([[0], np.cumsum(counts[:-1])]).astype(int).tolist()
    row = {"shard": shard, "block": block, "n_ids": sum(counts), "width": width, "keys": keys, "ats": ats, "counts": counts, "ids": b"".join(ids)}
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("keys", pa.list_(pa.string())), ("ats", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])
    return pa.RecordBatch.from_pylist([row], schema)


def _encoded(enc: Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
    """Each key with the raw ids of its text; the texts of several batches are encoded at once."""
    keys, texts, size = [], [], 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for at, part in some(batch.column(1)):
            keys += names[at : at + len(part)]
            texts += texts_of(part)
            size += part.nbytes
            if size >= RUN_CHARS:
                yield from zip(keys, enc.encode(texts))
                keys, texts, size = [], [], 0
    yield from zip(keys, enc.encode(texts))


def write_payload(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        enc = encoder(tokenizer, sent.value)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        shard, block, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        for key, raw in _encoded(enc, batches):
            raw += end
            if keys and size + len(raw) > BLOCK_IDS * enc.width:
                yield _block(shard, block, enc.width, keys, ids)
                block, keys, ids, size = block + 1, [], [], 0
            keys.append(key)
            ids.append(raw)
            size += len(raw)
        if keys:
            yield _block(shard, block, enc.width, keys, ids)

    rows = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"))
    # the text's hash breaks ties, so that copies of one key are dealt to several shards
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    rows = rows.select(F.col("id").cast("string").alias("key"), "text")
    rows.mapInArrow(run, PAYLOAD).write.options(**PAGES).partitionBy("shard").parquet(f"{path}/payload")


def payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).parquet(f"{path}/payload")


def places(spark: SparkSession, path: str) -> DataFrame:
    """``(key, shard, block, at, n_tokens)`` of every stored document; the ids are not read."""
    rows = payload(spark, path).select("shard", "block", F.explode(F.arrays_zip("keys", "ats", "counts")).alias("d"))
    return rows.select(F.col("d.keys").alias("key"), "shard", "block", F.col("d.ats").alias("at"), F.col("d.counts").alias("n_tokens"))


def checked_places(spark: SparkSession, path: str) -> DataFrame:
    """The places with the CRC-32 of each document's stored ids as 32-bit integers."""

    def run(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            crcs = [zlib.crc32(ids[at : at + n]) for at, n in zip(row["ats"], row["counts"])]
            n = len(crcs)
            cols = [pa.array(row["keys"], pa.string()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["ats"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "shard", "block", "at", "n_tokens", "ids_crc32"])

    return map_batches(payload(spark, path), run, PLACES)


def write_index(spark: SparkSession, path: str) -> None:
    """The index over all non-null keys; a key's entry is its first copy, the copies follow one another."""
    first = places(spark, path).where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("shard", "block", "at", "n_tokens")).alias("p"), F.count(F.lit(1)).alias("copies"))
    n = payload(spark, path).agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-n // BUCKET_KEYS))
    folders = min(buckets, FOLDERS)
    spark.createDataFrame([(buckets, folders)], META).coalesce(1).write.parquet(f"{path}/meta")
    keyed = first.select(*_bucket(F.col("key"), buckets, folders), F.struct("key", "p.*", "copies").alias("e"))
    grouped = keyed.repartition(folders, "folder").groupBy("folder", "bucket").agg(F.collect_list("e").alias("e"))

    def run(batch: pa.RecordBatch):
        names = INDEX.replace(",", "").split()[::2]
        out = {name: [] for name in names}
        for folder, bucket, entries in zip(*[c.to_pylist() for c in batch.columns]):
            a, b = key_hashes([e["key"].encode() for e in entries])
            table = MinimalPerfectHash.build(a, b)
            order = np.argsort(table.slots(a, b))
            cols = {c: np.array([e[c] for e in entries], "<i8")[order].tobytes() for c in ("shard", "block", "at", "n_tokens", "copies")}
            values = [folder, bucket, len(entries), table.to_bytes(), (b[order] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), *cols.values()]
            for name, value in zip(names, values):
                out[name].append(value)
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names)

    map_batches(grouped, run, INDEX).write.options(**PAGES).partitionBy("folder").parquet(f"{path}/index")


def _bucket(key, buckets: int, folders: int) -> list:
    """A key's folder and bucket."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    return [F.pmod(bucket, F.lit(folders)).cast("int").alias("folder"), bucket.cast("long").alias("bucket")]


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``(key, shard, block, at, n_tokens, copies)`` of the keys (column ``key``, text) that the index holds.

    A key that is not stored is told from a stored one by its fingerprint, with
    an error of 2**-32. Null keys are never found; keys asked twice answer once.
    For up to ``FEW`` keys only their buckets are read.
    """
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    asked = keys.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
    asked = asked.select("key", *_bucket(F.col("key"), meta.buckets, meta.folders))
    entries = index(spark, path)
    few = asked.limit(FEW + 1).collect()
    if len(few) <= FEW:
        asked = F.broadcast(spark.createDataFrame(few, "key string, folder int, bucket long"))
        entries = entries.where(F.col("folder").isin(sorted({r.folder for r in few})) & F.col("bucket").isin(sorted({r.bucket for r in few})))
    # a bucket's keys are dealt into parts, so that no task answers all of them
    asked = asked.groupBy("folder", "bucket", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(16)).alias("part")).agg(F.collect_list("key").alias("asked"))

    def run(batch: pa.RecordBatch):
        out = {k: [] for k in FOUND.replace(",", "").split()[::2]}
        for row in batch.to_pylist():
            a, b = key_hashes([k.encode() for k in row["asked"]])
            slots = MinimalPerfectHash.from_bytes(row["hash"]).slots(a, b)
            prints = np.frombuffer(row["prints"], "<u4")
            names = {"shard": "shards", "block": "blocks", "at": "ats", "n_tokens": "sizes", "copies": "copies"}
            cols = {c: np.frombuffer(row[name], "<i8") for c, name in names.items()}
            there = (slots >= 0) & (prints[np.maximum(slots, 0)] == (b & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            out["key"] += [k for k, ok in zip(row["asked"], there) if ok]
            for c, values in cols.items():
                out[c] += values[slots[there]].tolist()
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    joined = asked.join(entries, ["folder", "bucket"])
    return map_batches(joined.select("asked", "hash", "prints", "shards", "blocks", "ats", "sizes", "copies"), run, FOUND)


def read_ids(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``(key, ids)`` of the first copy of each stored key asked for, through the index; for up to ``FEW`` keys only their blocks are read."""
    found, blocks = lookup(spark, path, keys), payload(spark, path).select("shard", "block", "width", "ids")
    few = found.limit(FEW + 1).collect()
    if len(few) <= FEW:
        found = F.broadcast(spark.createDataFrame(few, FOUND))
        blocks = blocks.where(F.col("shard").isin(sorted({r.shard for r in few})) & F.col("block").isin(sorted({r.block for r in few})))
    found = found.join(blocks, ["shard", "block"])

    def run(batch: pa.RecordBatch):
        keys, ids = [], []
        for key, at, n, width, raw in zip(*[c.to_pylist() for c in batch.columns]):
            keys.append(key)
            ids.append(np.frombuffer(raw, f"<u{width}", n, at * width).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.list_(pa.int64()))], ["key", "ids"])

    return map_batches(found.select("key", "at", "n_tokens", "width", "ids"), run, "key string, ids array<long>")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, block, start)``: the ids stored before each block. Only sums by shard meet in one task."""
    sizes = payload(spark, path).select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    upto = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    within = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner"))
    return sizes.join(shards, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("start"))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text of ``docs`` and writes payload and index to ``path``.

    Null texts are empty and hold only the end id (if there is one). Documents
    lie in ascending order of ``id_col``, nulls first, copies of a key beside
    one another in the order of their text's hash; repeated rows are stored as
    often as they occur. Null keys are stored but not indexed. An empty table
    gives an empty store. Other columns are not read.
    """
    write_payload(docs, path, tokenizer, end_id, id_col, text_col)
    write_index(docs.sparkSession, path)


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``(key, start, n_tokens, ids_crc32, indexed)`` of every stored document.

    Every key is looked up; the row of a key is that of the ids at the place
    and of the number that the index gives for it. ``indexed`` tells that a row
    was found so: the first copy of every non-null key. Further copies, and
    documents without a key, follow from the directories of the blocks.
    ``start`` counts the ids of all documents before it.
    """
    asked = lookup(spark, path, places(spark, path).select("key"))
    found = asked.select(F.col("key").alias("found"), "shard", "block", "at", F.col("n_tokens").alias("n_found"))
    rows = checked_places(spark, path).join(block_starts(spark, path), ["shard", "block"]).join(found, ["shard", "block", "at"], "left")
    key, n = F.coalesce("found", "key"), F.coalesce("n_found", "n_tokens")
    return rows.select(key.alias("key"), (F.col("start") + F.col("at")).alias("start"), n.alias("n_tokens"), "ids_crc32", F.col("found").isNotNull().alias("indexed"))
