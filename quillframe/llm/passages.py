"""Substring deduplication: paragraphs by MinHash banding, and the pieces of passages inside them.

Equal paragraphs (lines of at least ``RUN`` words) share the key of their
shingles; near-equal ones collide in at least one of eight bands of three MinHash values; at a Jaccard similarity of 0.8
over five-word shingles all but 0.3 % do. Each paragraph is compared, by the
exact Jaccard similarity, with the leader of each of its buckets. Where a bucket
then still holds several components, every member outside the largest is
compared with all members of the other components: members of the largest are
joined already, so no colliding pair is left out and no group is expanded into
all its pairs. Where that would be more than ``PAIRS`` comparisons, the members
meet by their rarest shingles instead: two sets of similarity 0.8 always share
one of the rarest fifth of either. A bit array of the shingles bounds the
similarity from above inside these joins, so that only pairs that may be similar
leave them. Components of the verified links are the removal classes.

A passage can also sit inside a longer paragraph. Texts are therefore cut, too,
at points that their words define (a pair of words whose hash is least among its
neighbours), so that equal passages give equal pieces wherever they stand, and
runs of adjacent pieces that another document holds are found by key.

Of each class, and of each piece, the document with the least id keeps its copy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Workspace, claim, fresh, map_batches, small, some, utf8
from quillframe.llm.components import connected_components
from quillframe.llm.hashes import slice_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 8, 3
#: Word pairs on either side that a cut's hash is less than.
REACH = 4
#: Least words of what is removed: of a paragraph that other documents hold, or of a run of at least two pieces.
RUN = 20
#: Bits for each key of a filter that tells executors which keys are shared, and most bits of a filter; more keys than that only let more rows through.
FILTER_KEY_BITS, FILTER_BITS = 16, 1 << 27
#: Comparisons in a bucket from which its members meet by their rarest shingles.
PAIRS = 1 << 20
#: Members that meet in one rare shingle and are compared in one piece of work.
CELL = 512
#: Bytes of texts that are read at once.
STEP = 1 << 20

_MULT, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Which bytes are white space.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: What a key is of, besides bands 0 and up: a piece, or a whole paragraph.
_PIECE, _WHOLE = np.int8(-1), np.int8(-2)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MULT)


def word_hashes(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return slice_hashes(b"".join(words), np.cumsum(sizes) - sizes, sizes)


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """32-bit hashes of the five-word shingles that start at each word but the last four."""
    n = max(0, len(hashes) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for shift in range(SHINGLE):
            out = (out ^ (out >> np.uint64(29))) * _MULT + hashes[shift : shift + n]
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set of shingles; a shingle that occurs again changes nothing."""
    flat = np.concatenate(sets).astype(np.uint64)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for i, seed in enumerate(_SEEDS):
            x = (flat ^ seed) * _MULT
            x ^= x >> np.uint64(29)
            least = np.minimum.reduceat(x * _SECOND, starts)
            keys[i // ROWS] = mix(keys[i // ROWS] * _MULT + least)
    return keys.T


def cuts(hashes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """First words of the pieces of the texts that begin at ``starts``; each start is one."""
    n = len(hashes)
    starts = np.zeros(min(n, 1), np.int64) if starts is None else starts
    if n < 2:
        return starts
    sizes = np.diff(np.append(starts, n))
    local = np.arange(n) - np.repeat(starts, sizes)
    first = (local >= REACH) & (local < np.repeat(sizes, sizes) - 1 - REACH)
    least = first[:-1]
    with np.errstate(over="ignore"):
        pair = mix(hashes[:-1] * _MULT + hashes[1:])
    for shift in range(1, REACH + 1):
        least[shift:] &= pair[shift:] < pair[:-shift]
        least[:-shift] &= pair[:-shift] < pair[shift:]
    first[starts] = True
    return np.flatnonzero(first)


def piece_keys(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A key for the words of each piece."""
    sizes = np.diff(np.append(firsts, len(hashes)))
    at = np.arange(len(hashes), dtype=np.int64) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        spread = mix(hashes + (at + 1).astype(np.uint64) * _SECOND)
        return mix(np.add.reduceat(spread, firsts) + sizes.astype(np.uint64))


def _paragraphs(hashes: np.ndarray, lines: np.ndarray | list[tuple[int, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Shingles of the paragraphs, and ids: keys of their words."""
    shingles = shingle_hashes(hashes)
    lines = np.asarray(lines, np.int64).reshape(-1, 2)
    sets = [shingles[a : b - SHINGLE + 1] for a, b in lines.tolist()]
    if not sets:
        return sets, np.zeros(0, np.uint64)
    sizes = lines[:, 1] - lines[:, 0]
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words = np.arange(sizes.sum()) + np.repeat(lines[:, 0] - firsts, sizes)
    return sets, piece_keys(hashes[words], firsts)


class Texts:
    """Some texts at once: hashes of all their words, where each text starts, its pieces and its paragraphs."""

    def __init__(self, texts: list[bytes]):
        text = b"\n".join([*texts, b""]).lower()
        buffer = np.frombuffer(text, np.uint8)
        # a word begins after white space, and ends before some
        white = np.concatenate([[True], _WHITE[buffer], [True]])
        edges = np.flatnonzero(white[1:] != white[:-1])
        firsts, stops = edges[::2], edges[1::2]
        self.hashes = slice_hashes(text, firsts, stops - firsts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.starts = np.append(0, np.searchsorted(firsts, ends)).astype(np.int64)
        breaks = np.flatnonzero(buffer == 0x0A)
        after = np.searchsorted(firsts, breaks)
        before = np.append(0, after[:-1])[: len(after)]
        long = np.flatnonzero(after - before >= RUN)
        self.lines = np.stack([before[long], after[long]], axis=1).astype(np.int64)
        self.line_text = np.searchsorted(ends, breaks[long], "right").astype(np.int64)
        self.firsts = cuts(self.hashes, self.starts[:-1][np.diff(self.starts) > 0])
        self.stops = np.append(self.firsts[1:], len(self.hashes))
        self.piece_text = np.searchsorted(self.starts, self.firsts, "right") - 1
        self.pieces = piece_keys(self.hashes, self.firsts) if len(self.firsts) else np.zeros(0, np.uint64)
        self.sets, self.ids = _paragraphs(self.hashes, self.lines)

    def bands(self) -> np.ndarray:
        """Band keys of the paragraphs."""
        return band_keys(self.sets) if self.sets else np.zeros((0, BANDS), np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def _keys_of(batch: pa.RecordBatch):
    """Rows (band, key, value): pieces and whole paragraphs with their document, bands with their paragraph."""
    claim("passages")
    docs = batch.column(0).to_numpy().view(np.uint64)
    for a, texts in some(batch.column(1), STEP):
        t = Texts(texts.to_pylist())
        own = docs[a : a + len(texts)]
        found = t.bands()
        bands = [np.full(len(t.pieces), _PIECE), np.full(len(t.ids), _WHOLE), *[np.full(len(found), i, np.int8) for i in range(BANDS)]]
        keys = [t.pieces, t.ids, *found.T]
        values = [own[t.piece_text], own[t.line_text], *[t.ids] * BANDS]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bands)), _signed(np.concatenate(keys)), _signed(np.concatenate(values))], ["band", "key", "value"])


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit array with the bit of every ``key`` set; its size, a power of two, is that of the keys up to a bound."""
    size = min(FILTER_BITS, 1 << max(6, (FILTER_KEY_BITS * keys.count()).bit_length()))
    bits = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, int(bit & 63))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _in_runs(flags: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of flagged pieces, those in a run within one text that has two pieces and ``RUN`` words."""
    if not len(flags):
        return flags
    new = np.ones(len(flags), bool)
    new[1:] = (flags[1:] != flags[:-1]) | (texts[1:] != texts[:-1])
    firsts = np.flatnonzero(new)
    n = np.diff(np.append(firsts, len(flags)))
    return flags & np.repeat((n >= 2) & (np.add.reduceat(sizes, firsts) >= RUN), n)


OCCURRENCE = "doc long, text_key long, part int, start int, stop int, key long, shingles binary, bands array<long>"


def _occurrences(sent):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip([x.split()[0] for x in OCCURRENCE.split(", ")], kinds)))

    def run(batch: pa.RecordBatch):
        claim("passages")
        pieces, wholes, buckets = sent.value
        docs, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, texts in some(batch.column(2), STEP):
            t = Texts(texts.to_pylist())
            b = a + len(texts)
            i = np.flatnonzero(_in_runs(_passes(pieces, t.pieces), t.piece_text, t.stops - t.firsts))
            at = t.piece_text[i]
            part = i - np.searchsorted(t.piece_text, at)
            places = [x.astype(np.int32) for x in (part, t.firsts[i] - t.starts[at], t.stops[i] - t.starts[at])]
            cols = [docs[a:b][at], keys[a:b][at], *places, t.pieces[i].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(i), kinds[6]), pa.nulls(len(i), kinds[7])], schema=schema)
            found = t.bands()
            j = np.flatnonzero(_passes(buckets, found).any(axis=1) | _passes(wholes, t.ids))
            at = t.line_text[j]
            lines = (t.lines[j] - t.starts[at][:, None]).astype(np.int32)
            sets = [np.unique(t.sets[k]).tobytes() for k in j]
            bands = [found[k].view(np.int64) for k in j]
            cols = [pa.array(docs[a:b][at]), pa.array(keys[a:b][at]), pa.nulls(len(j), kinds[2]), pa.array(lines[:, 0]), pa.array(lines[:, 1])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(t.ids[j].view(np.int64)), pa.array(sets, kinds[6]), pa.array(bands, kinds[7])], schema=schema)

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of paragraph ids whose shingle sets reach the similarity."""

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)) else 0
            out.append(both >= SIMILAR * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    left = sets.select(F.col("key").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("key").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").where(similar("a", "b")).select("u", "v")


def _marked(sets: DataFrame) -> DataFrame:
    """``(key, x)``: of each paragraph the number of shingles ``n``, a bit array of them, ``b0`` to ``b3``, and its band keys, ``k0`` and on."""

    @F.arrow_udf("struct<b0:long,b1:long,b2:long,b3:long>")
    def bits(shingles: pa.Array) -> pa.Array:
        out = np.zeros((len(shingles), 256), bool)
        for row, x in zip(out, shingles.to_pylist()):
            row[np.frombuffer(x, np.uint32) % 256] = True
        words = np.packbits(out, axis=1, bitorder="little").view(np.int64).reshape(-1, 4)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)], ["b0", "b1", "b2", "b3"])

    rows = sets.select("key", "bands", (F.octet_length("shingles") / 4).cast("int").alias("n"), bits("shingles").alias("b"))
    return rows.select("key", F.struct("key", "n", "b.*", *[F.get("bands", i).alias(f"k{i}") for i in range(BANDS)]).alias("x"))


def _may_be_similar(x: str, y: str) -> Column:
    """What two similar paragraphs (struct columns) always meet.

    A bit that only one side has stands for a shingle that only that side has,
    and similar sets leave each side but few of those.
    """
    shared = SIMILAR / (1 + SIMILAR) * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def only(a: str, b: str) -> Column:
        counts = [F.bit_count(F.col(f"{a}.b{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.b{i}")))) for i in range(4)]
        return counts[0] + counts[1] + counts[2] + counts[3]

    return (only(x, y) <= F.col(f"{x}.n") - shared + 1e-6) & (only(y, x) <= F.col(f"{y}.n") - shared + 1e-6)


def paragraph_classes(sets: DataFrame, ws: Workspace) -> DataFrame:
    """``(node, component)`` of the paragraphs ``sets(key, shingles, bands)`` linked by similarity, from all pairs that collide in a band."""
    marks = ws.save(_marked(sets), "marks")
    banded = sets.select("key", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("band", "bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    buckets = ws.save(buckets.select("band", "bucket", "size"), "buckets")
    members = ws.save(banded.join(buckets, ["band", "bucket"]), "members")
    # a bucket's leader is the member that meets most others over all bands: the least changed of a group of copies
    scores = ws.save(members.groupBy("key").agg(F.sum("size").alias("score")), "scores")
    leaders = ws.save(members.join(scores, "key").groupBy("band", "bucket").agg(F.max_by("key", F.struct("score", "key")).alias("leader")), "leaders")
    pairs = members.join(leaders, ["band", "bucket"]).where("key <> leader").select(F.col("key").alias("u"), F.col("leader").alias("v")).distinct()
    left, right = (marks.select(F.col("key").alias(k), F.col("x").alias(x)) for k, x in (("u", "x"), ("v", "y")))
    pairs = pairs.join(left, "u").join(right, "v").where(_may_be_similar("x", "y")).select("u", "v")
    links = ws.save(_verified(pairs, sets), "links")
    classes = ws.save(connected_components(links, ws, "first"), "first")
    named = members.join(classes, F.col("key") == F.col("node"), "left").select("band", "bucket", "key", F.coalesce("component", "key").alias("c"))
    named = ws.save(named, "named")
    sizes = named.groupBy("band", "bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("band", "bucket").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.max("n").alias("n_most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    work = (F.col("n") - F.col("n_most")) * F.col("n")
    open_ = ws.save(open_.select("band", "bucket", "most", (work > PAIRS).alias("crowded")), "open")
    rest = ws.save(named.join(open_, ["band", "bucket"]).join(marks, "key").select("band", "bucket", "x", "c", "most", "crowded"), "rest")
    by_prefix = _rare_meetings(rest.where("crowded"), sets, ws)
    rest = rest.where("NOT crowded")
    out = rest.where("c <> most").select("band", "bucket", "x", F.col("c").alias("cx"))
    others = rest.select("band", "bucket", F.col("x").alias("y"), F.col("c").alias("cy"))
    # a pair that meets in several bands is looked at in the first of them
    new = (F.col("cx") != F.col("cy")) & _may_be_similar("x", "y")
    for i in range(BANDS - 1):
        new &= (F.col("band") <= i) | (F.col(f"x.k{i}") != F.col(f"y.k{i}"))
    pairs = out.join(others, ["band", "bucket"]).where(new)
    pairs = pairs.select(F.greatest("x.key", "y.key").alias("u"), F.least("x.key", "y.key").alias("v"))
    more = ws.save(_verified(pairs.union(by_prefix).distinct(), sets), "more")
    return ws.save(connected_components(links.union(more), ws, "second"), "classes")


def _prefixes(members: DataFrame, sets: DataFrame, ws: Workspace) -> DataFrame:
    """``(key, shingle)``: of each member the rarest shingles, one more than those that a similar set may lack.

    All members rank their shingles alike, by the number of members that have
    them, so similar sets share one of these.
    """

    def spread(batch: pa.RecordBatch):
        claim("passages")
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(raw, np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], ["key", "shingle"])

    rows = map_batches(sets.join(members.select("key"), "key", "left_semi").select("key", "shingles"), spread, "key long, shingle long")
    rows = ws.save(rows, "shingles")
    ranked = rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "shingle").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    n = F.size("s")
    own = F.slice("s", F.lit(1), (n - F.ceil(SIMILAR * n - 1e-6) + 1).cast("int"))
    # a shingle that no other member has meets none
    return ranked.select("key", F.explode(F.filter(own, lambda s: s["df"] > 1)).alias("s")).select("key", "s.shingle")


def _rare_meetings(crowded: DataFrame, sets: DataFrame, ws: Workspace) -> DataFrame:
    """``(u, v)`` of members of crowded buckets, in different components, that share a band and may be similar."""
    members = ws.save(crowded.groupBy(F.col("x.key").alias("key")).agg(F.first("x").alias("x"), F.first("c").alias("c")), "hot-members")
    met = ws.save(_prefixes(members, sets, ws), "prefixes")
    cells = met.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    met = met.join(cells, "shingle").join(members, "key")
    # one side of a cell is dealt into parts of about CELL members, the other meets each part
    left = met.select("shingle", F.pmod(F.hash("key"), F.col("parts")).alias("part"), "x", F.col("c").alias("cx"))
    right = met.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("x").alias("y"), F.col("c").alias("cy"))
    collide = F.lit(False)
    for i in range(BANDS):
        collide |= F.col(f"x.k{i}") == F.col(f"y.k{i}")
    pairs = left.join(right, ["shingle", "part"]).where((F.col("x.key") > F.col("y.key")) & (F.col("cx") != F.col("cy")) & collide & _may_be_similar("x", "y"))
    return pairs.select(F.col("x.key").alias("u"), F.col("y.key").alias("v"))


def shared_passages(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, text_key, spans)``: word ranges to remove, by document id and hash of its text; only documents with some."""
    spark = docs.sparkSession
    text = utf8(F.col(f"`{text_col}`"))
    rows = docs.select(_doc(id_col), text.alias("text"))
    shared = map_batches(rows, _keys_of, "band byte, key long, value long").groupBy("band", "key").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi")
    shared = ws.save(shared.select("band", "key", "lo"), "shared")
    pieces = shared.where(f"band = {_PIECE}")
    sent = spark.sparkContext.broadcast((_filter_of(pieces), _filter_of(shared.where(f"band = {_WHOLE}")), _filter_of(shared.where("band >= 0"))))
    rows = docs.select(_doc(id_col), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = ws.save(map_batches(rows, _occurrences(sent), OCCURRENCE), "found")

    owned = found.where("part IS NOT NULL").drop("shingles", "bands").join(pieces.select("key", "lo"), "key").where("doc <> lo")
    order = ["doc", "text_key"]
    parts = owned.groupBy(*order).agg(F.sort_array(F.collect_set(F.struct("part", "start", "stop"))).alias("parts"))
    # adjacent pieces are joined and runs that are too short are left out
    runs = parts.select(*order, F.arrow_udf(_joined, "array<struct<start:int,stop:int>>")("parts").alias("spans"))

    lines = found.where("part IS NULL")
    sets = ws.save(lines.groupBy("key").agg(F.min("shingles").alias("shingles"), F.first("bands").alias("bands")), "sets")
    classes = paragraph_classes(sets, ws)
    named = lines.select("doc", "text_key", "start", "stop", "key").join(classes, F.col("key") == F.col("node"), "left")
    named = ws.save(named.select("doc", "text_key", "start", "stop", F.coalesce("component", "key").alias("component")), "lines")
    owner = ws.save(named.groupBy("component").agg(F.min("doc").alias("lo")), "owners")
    near = named.join(owner, "component").where("doc <> lo").groupBy(*order).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    both = runs.union(near).groupBy(*order).agg(F.flatten(F.collect_list("spans")).alias("spans")).where(F.size("spans") > 0)
    return ws.save(both, "spans")


def _joined(lists: pa.Array) -> pa.Array:
    out = []
    for parts in lists.to_pylist():
        runs: list[list[int]] = []
        for p in parts:
            if runs and runs[-1][0] + 1 == p["part"]:
                runs[-1][0], runs[-1][1], runs[-1][3] = p["part"], runs[-1][1] + 1, p["stop"]
            else:
                runs.append([p["part"], 1, p["start"], p["stop"]])
        out.append([{"start": a, "stop": b} for _, n, a, b in runs if n >= 2 and b - a >= RUN])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def _doc(id_col: str):
    """A document's id as a number; a null id counts as the least of all."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("doc")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the words of the ranges, the words removed, and the ranges after merging.

    White space after a removed range goes with it; a line end before or after
    it stays, once.
    """
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in merged:
        first, after = at[a][0], at[b][0] if b < len(at) else len(text)
        before = text[done:first]
        if b == len(at):
            before = before.rstrip()
        elif b"\n" in text[at[b - 1][1] : after] and b"\n" not in text[at[a - 1][1] if a else 0 : first] and a:
            before = before.rstrip() + b"\n"
        out.append(before)
        done = after
    out.append(text[done:])
    return b"".join(out), sum(b - a for a, b in merged), len(merged)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "passages") -> DataFrame:
    """``docs`` with repeated passages cut out of the text column, and a struct column ``out`` of (n_removed, n_spans).

    Of passages that several documents share, the document with the least id
    keeps its copy. Rows of one id are one document in this: they keep what
    they share among themselves (a null id counts as one document before all
    others). Null texts stay null, texts without a shared passage stay as they
    are, a text that is wholly shared becomes empty. A column already named
    ``out`` is replaced; all other columns are kept, whatever their names.
    """
    ws = Workspace(docs.sparkSession, "passages")
    spans = shared_passages(docs, ws, id_col, text_col)
    text = utf8(F.col(f"`{text_col}`"))
    doc, key, list_, cut = fresh(docs, "doc", "text_key", "spans", "cut")
    keyed = docs.withColumns({doc: _doc(id_col), key: F.xxhash64(text)})
    spans = small(spans.select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(list_)), 16 + 16 * F.size(list_))

    @F.arrow_udf("struct<text:string,n_removed:long,n_spans:long>")
    def apply(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for t, found in zip(texts.to_pylist(), lists.to_pylist()):
            if t is None:
                rows.append((None, None, None))
                continue
            cut = cut_out(t, [(s["start"], s["stop"]) for s in found])
            rows.append((cut[0].decode("utf-8", "replace"), *cut[1:]))
        cols = list(zip(*rows)) or [()] * 3
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["text", "n_removed", "n_spans"])

    rows = keyed.join(spans, [doc, key], "left")
    # only texts with something to cut go to Python; a filter on the result must not cut them once more
    shared = F.col(list_).isNotNull()
    rows = rows.withColumn(cut, apply.asNondeterministic()(F.when(shared, text), F.col(list_)))
    made = F.struct(F.coalesce(f"{cut}.n_removed", F.lit(0)).alias("n_removed"), F.coalesce(f"{cut}.n_spans", F.lit(0)).alias("n_spans"))
    kept = F.when(shared, F.col(f"{cut}.text")).otherwise(F.col(f"`{text_col}`").cast("string"))
    return rows.withColumn(text_col, kept).withColumn(out, made).select(*[f"`{c}`" for c in docs.columns if c != out], out)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the text without shared passages, n_words before, n_removed, n_spans, changed."""
    rows = docs.select("doc_id", "text", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")).cast("long").alias("n_words"))
    return dedup_passages(rows).select("doc_id", "text", "n_words", "passages.n_removed", "passages.n_spans", (F.col("passages.n_removed") > 0).alias("changed"))


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shared passages cut out, with their own columns and any others; rows go that had words and have none left.

    Null and empty texts, which had none, stay. Of ties and repeated rows, and
    of clashing names, see ``dedup_passages``; an empty table stays empty.
    """
    (out,) = fresh(docs, "passages")
    done = dedup_passages(docs, id_col, text_col, out=out)
    left = F.length(F.btrim(F.col(f"`{text_col}`"), F.lit(" \t\n\r\x0b\x0c"))) > 0
    return done.where((F.col(f"{out}.n_removed") == 0) | left).drop(out)
