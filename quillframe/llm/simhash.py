"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is embedded as its 32 counts of set bits in 2-bit segments, each
0 to 2. The Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints, so links within Hamming distance 2 lie within
Manhattan distance 2. The grid: the 32 coordinates are split into six groups;
within that distance at least four groups agree, so the two points meet in one
of the 15 cells that fix four groups. Cells with few members are compared by
the lower bound and then exactly. A cell with more members than ``CELL`` is not
compared pair by pair: each member names the fingerprints one bit away, and two
fingerprints are within distance 2 exactly when they name a common one, which
costs 65 rows per member instead of a row per pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Workspace, claim, fresh, map_batches, small, some, utf8
from quillframe.llm.components import connected_components

#: Fingerprints link at so many differing bits or fewer; grid and midpoints rest on this number.
BITS = 2
#: Most fingerprints in a cell that are compared pair by pair.
CELL = 64
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15
#: Segments (of 2 bits) in each of the six groups.
GROUPS = (6, 6, 5, 5, 5, 5)
LOW_BITS = 0x5555555555555555
#: Rows of one fingerprint from which its copies are looked up in a broadcast table; the table holds one in so many rows at most.
HOT = 100_000


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _group_masks() -> list[int]:
    masks, at = [], 0
    for n in GROUPS:
        masks.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    return masks


def cell_masks() -> list[int]:
    """The coordinates, as a mask of the packed embedding, that each of the 15 grids fixes."""
    return [sum(c) for c in combinations(_group_masks(), 4)]


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles, repeats included; 0 without words.

    A-Z is lower-cased, words are runs without ASCII white space, and fewer
    words than ``shingle`` make one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)`` for every row; ``fp`` holds the 64 bits as a signed long, ``text_key`` is a hash of the text."""

    def run(batch: pa.RecordBatch):
        claim("simhash")
        fps = np.array([simhash(t) for _, run in some(batch.column(2)) for t in run.to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_key", "fp"])

    text = utf8(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return map_batches(rows, run, "doc_id long, text_key long, fp long")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, smaller member) that connect the members of one small cell that lie within ``BITS``."""
    fps = np.sort(fps)
    packed = fps.view(np.uint64)
    emb = packed - ((packed >> np.uint64(1)) & np.uint64(LOW_BITS))
    coords = (emb[:, None] >> (2 * np.arange(32, dtype=np.uint64))) & np.uint64(3)
    coords = coords.astype(np.int8)
    near = np.abs(coords[:, None, :] - coords[None, :, :]).sum(axis=2) <= BITS
    a, b = np.nonzero(np.triu(near, 1))
    exact = np.bitwise_count(packed[a] ^ packed[b]) <= BITS
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(a[exact].tolist(), b[exact].tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(fps[j]), int(fps[i])))
    return out


def links(distinct: DataFrame, ws: Workspace) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the fingerprints ``fp`` linked within ``BITS`` differing bits."""
    fp, next_bit = F.col("fp"), F.shiftrightunsigned("fp", 1)
    both = F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(F.lit(LOW_BITS)), 1)
    emb = both.bitwiseOR(fp.bitwiseXOR(next_bit).bitwiseAND(F.lit(LOW_BITS)))
    cells = F.array(*[F.struct(F.lit(i).cast("byte").alias("grid"), F.col("emb").bitwiseAND(F.lit(signed(m))).alias("cell")) for i, m in enumerate(cell_masks())])
    keyed = distinct.select("fp", emb.alias("emb")).select("fp", F.explode(cells).alias("k")).select("fp", "k.grid", "k.cell")
    met = keyed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    met = ws.save(met, "cells")
    near = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= BITS
    pairs = met.where((F.col("n") == 2) & near).select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    many = ws.save(keyed.join(met.where("n > 2").select("grid", "cell", "n"), ["grid", "cell"]), "crowded")

    def compare(batch: pa.RecordBatch):
        out: set[tuple[int, int]] = set()
        values = batch.column(0)
        flat, ends = values.flatten().to_numpy(), values.offsets.to_numpy()
        ends = ends - ends[0]
        for a, b in zip(ends[:-1], ends[1:]):
            out.update(_forest(flat[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    small = many.where(F.col("n") <= CELL).groupBy("grid", "cell").agg(F.collect_list("fp").alias("fps")).select("fps")
    small = map_batches(small, compare, "u long, v long")
    hot = many.where(F.col("n") > CELL).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    named = hot.select("fp", F.explode(flips).alias("mid"))
    shared = ws.save(named.groupBy("mid").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("v")).where("n > 1").select("mid", "v"), "mids")
    far = named.join(shared, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(small).union(far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SimHash classes of ``docs``: ``(doc_id, fingerprint, component_id, n_fingerprints)``, one row per input row.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` is the smallest
    doc_id reachable over links of at most ``BITS`` differing bits, the row
    itself included; ``n_fingerprints`` counts the different fingerprints of
    that class. Null and empty texts have fingerprint 0 and
    link like any other. A null doc_id keeps its row and takes the class's
    smallest non-null id, null if there is none. Repeated rows are repeated in
    the result. Other columns of ``docs`` are not read. An empty table gives an
    empty result.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.save(fingerprints(docs, id_col, text_col), "fps")
    return with_classes(fps, fingerprint_classes(fps, ws)).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_fingerprints",
    )


def fingerprint_classes(fps: DataFrame, ws: Workspace) -> DataFrame:
    """``(fp, n_rows, root, component_id, n_fingerprints)`` of every fingerprint in ``fps(doc_id, fp)``; ``root`` names the class."""
    distinct = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows")), "distinct")
    classes = ws.save(connected_components(links(distinct, ws), ws), "classes")
    joined = distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n_rows", "least", F.coalesce("component", "fp").alias("root"))
    joined = ws.save(joined, "joined")
    first = ws.save(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_fingerprints")), "first")
    return ws.save(joined.join(first, "root").select("fp", "n_rows", "root", "component_id", "n_fingerprints"), "of")


def with_classes(fps: DataFrame, of: DataFrame) -> DataFrame:
    """``fps`` with the class of each row's fingerprint.

    The classes of fingerprints with ``HOT`` rows or more are broadcast, so
    that the copies of one text do not meet in one task.
    """
    hot = of.where(F.col("n_rows") >= HOT)
    rare = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(of.where(F.col("n_rows") < HOT), "fp")
    return rare.unionByName(fps.join(F.broadcast(hot), "fp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one of each class, of the document with the least id.

    Null ids come after all others. Of rows that share the least id of a class
    the one whose text has the least hash stays, and of equal rows one.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    last = F.lit((1 << 63) - 1)
    fps = ws.save(fingerprints(docs, id_col, text_col).select(F.coalesce("doc_id", last).alias("doc_id"), "text_key", "fp"), "fps")
    roots = ws.save(with_classes(fps, fingerprint_classes(fps, ws)).groupBy("doc_id", "text_key", "root").agg(F.count(F.lit(1)).alias("n")), "roots")
    key, text = fresh(docs, "id", "text")
    kept = roots.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
    gone = roots.join(kept, "root").where((F.col("doc_id") != F.col("k.doc_id")) | (F.col("text_key") != F.col("k.text_key")))
    gone = ws.save(gone.select(F.col("doc_id").alias(key), F.col("text_key").alias(text)), "gone")
    keyed = docs.withColumns({key: F.coalesce(F.col(f"`{id_col}`").cast("long"), last), text: F.xxhash64(utf8(F.col(f"`{text_col}`")))})
    stay = keyed.join(small(gone, 16), [key, text], "left_anti")
    if not roots.where("n > 1").isEmpty():
        stay = stay.dropDuplicates([key, text])
    return stay.drop(key, text)
