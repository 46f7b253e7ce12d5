"""Best-fit packing of documents into token sequences, under conflicts.

A document of more than one sequence is cut into full sequences and a rest. The
rests are dealt, evenly and at random, into shards of bounded size that are
packed apart from one another. In a shard, rests are placed in falling order of
length; each goes to the bin with the least room that still suffices and that
holds neither its source nor a copy of it. Bins are kept in the order of their
room, each with one bitmap of sources and one of clusters of copies; the search
starts at the least room that suffices and goes on to the next bin until one is
compatible, and a new bin is opened where none is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import Workspace, some, utf8
from quillframe.llm.encode import TokenCounter, encoder

#: Tokens in a sequence.
CAPACITY = 2048
#: Documents in a shard, about.
SHARD_ROWS = 4096

RESULT = "doc_id long, piece long, start long, n_tokens long, bin_id long, offset long"


class Bins:
    """Open bins by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and the offset for a rest whose source and cluster are bits (0: none)."""
        for room in self.rooms[bisect_left(self.rooms, size) :]:
            for b in self.at[room]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._leave(b, room)
                    return b, self._enter(b, room, size, source, cluster)
        b = len(self.room)
        self.room.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return b, self._enter(b, self.capacity, size, source, cluster)

    def _leave(self, b: int, room: int) -> None:
        self.at[room].remove(b)
        if not self.at[room]:
            del self.at[room]
            self.rooms.pop(bisect_left(self.rooms, room))

    def _enter(self, b: int, room: int, size: int, source: int, cluster: int) -> int:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        left = self.room[b] = room - size
        if left:
            if left not in self.at:
                self.at[left] = []
                insort(self.rooms, left)
            insort(self.at[left], b)
        return self.capacity - room


def pack(rows: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """(doc_id, piece, start, n_tokens, bin, offset) of ``rows`` of (doc_id, n_tokens, source, cluster).

    A null source or cluster conflicts with nothing. Rests of one length are
    placed in the order of doc_id (nulls last), cluster and source.
    """
    last = (1, 0)
    rows = sorted(rows, key=lambda r: (-(r[1] % capacity), (0, r[0]) if r[0] is not None else last, r[1], str(r[3]), str(r[2])))
    source_bit = {s: 1 << i for i, s in enumerate(sorted({r[2] for r in rows if r[2] is not None}))}
    twice = sorted(c for c, n in Counter(r[3] for r in rows if r[3] is not None and r[1] % capacity).items() if n > 1)
    cluster_bit = {c: 1 << i for i, c in enumerate(twice)}
    bins, out = Bins(capacity), []
    for doc_id, n, source, cluster in rows:
        if n % capacity:
            b, offset = bins.place(n % capacity, source_bit.get(source, 0), cluster_bit.get(cluster, 0))
            out.append((doc_id, n // capacity, n - n % capacity, n % capacity, b, offset))
    full = len(bins.room)
    for doc_id, n, _, _ in rows:
        for piece in range(n // capacity):
            out.append((doc_id, piece, piece * capacity, capacity, full, 0))
            full += 1
    return out


def content_cluster(text: bytes) -> int | None:
    """A key that texts share if they are equal but for the case of A-Z and white space; None without a word."""
    words = text.lower().split()
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def measured(spark: SparkSession, text: Column, tokenizer: str, cache_bytes: int | None = None) -> Column:
    """(n_tokens, cluster) of each text (bytes); the tokenizer file is sent from the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("struct<n_tokens:long,cluster:long>")
    def measure(texts: pa.Array) -> pa.Array:
        counter, sizes, clusters = encoder(tokenizer, sent.value, TokenCounter, cache_bytes), [], []
        for _, run in some(texts):
            raw = run.to_pylist()
            sizes += counter.encode([t.decode("utf-8", "replace") for t in raw])
            clusters += map(content_cluster, raw)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(clusters, pa.int64())], ["n_tokens", "cluster"])

    return measure(text)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_tokens: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster=None, cache_bytes: int | None = None) -> DataFrame:
    """Where each piece of each document goes: ``(doc_id, piece, start, n_tokens, bin_id, offset)``.

    Token ids ``start`` up to ``start + n_tokens`` of the document (its ids and
    ``end_tokens`` end ids) stand in sequence ``bin_id`` from ``offset`` on. A
    rest never shares a bin with a rest of its source or with a copy of itself
    (``cluster``, a column; by default texts equal but for case and white
    space). A null source conflicts with nothing; null and empty texts hold
    only their end ids. Every row is packed, repeated ones as often as they
    occur; an empty table packs to nothing. Other columns are not read.
    ``cache_bytes`` is what a Python worker remembers of pieces of texts before
    it starts anew (up to twice as much is held); it changes the speed only.
    """
    ws = Workspace(docs.sparkSession, "packing")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        measured(docs.sparkSession, utf8(F.col(f"`{text_col}`")), tokenizer, cache_bytes).alias("m"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        (F.lit(None) if cluster is None else cluster).cast("long").alias("cluster"),
    )
    own = F.col("m.cluster") if cluster is None else F.col("cluster")
    rows = rows.select("doc_id", (F.col("m.n_tokens") + end_tokens).alias("n_tokens"), "source", own.alias("cluster"))
    rows = ws.save(rows, "sizes")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    # a number per stored row, so that copies of a row are dealt like any others
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(key, table):
        shard = key[0].as_py()
        cols = [table[c].to_pylist() for c in ("doc_id", "n_tokens", "source", "cluster")]
        found = [(*r[:4], (shard << 32) + r[4], r[5]) for r in pack(list(zip(*cols)), capacity)]
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 6)], names=names)

    return dealt.groupBy("shard").applyInArrow(run, RESULT)
