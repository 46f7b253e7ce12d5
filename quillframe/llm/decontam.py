"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. Patterns of one length form one
search table: the shift of a block (two adjacent words; one for patterns of one
word) tells how far the search may jump, blocks that end a pattern lead to a
bucket of patterns by that suffix and by their first words, and a direct
comparison confirms an occurrence.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import claim, fresh, some, utf8

#: Words in a window.
WINDOW = 10
#: Bytes of item texts that one search table set may come from; more items are searched in blocks.
TABLE_BYTES = 8 << 20

#: A-Z in lower case; all that is no digit, letter a-z or byte of a non-ASCII character becomes a space.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

SPAN_TYPE = "array<struct<start:int,stop:int>>"
HITS_TYPE = f"struct<n_words:long,n_hit:long,spans:{SPAN_TYPE},items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class SearchTable:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, items in patterns.items():
            for stop in range(self.block, length + 1):
                key = pattern[stop - self.block : stop]
                self.shift[key] = min(self.shift.get(key, self.far), length - stop)
            bucket = self.buckets.setdefault(pattern[length - self.block :], {})
            bucket.setdefault(pattern[: self.block], []).append((pattern, items))

    def search(self, words: list[bytes]) -> list[tuple[int, set[str]]]:
        """Occurrences as (first word, item ids)."""
        found = []
        length, block, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        at, n = length - 1, len(words)
        while at < n:
            key = (words[at - 1], words[at]) if block == 2 else (words[at],)
            jump = shift.get(key, far)
            if jump:
                at += jump
                continue
            first = at - length + 1
            for pattern, items in buckets[key].get(tuple(words[first : first + block]), ()):
                if pattern == tuple(words[first : at + 1]):
                    found.append((first, items))
            at += 1
        return found


def build_tables(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[SearchTable]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[at : at + size]), set()).add(item)
    return [SearchTable(patterns, size) for size, patterns in sorted(by_length.items())]


def find(words: list[bytes], tables: list[SearchTable]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges covered by occurrences, and the ids of the items that occur."""
    spans, items = [], set()
    for table in tables:
        for first, ids in table.search(words):
            spans.append((first, first + table.length))
            items |= ids
    return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


#: The tables of the block a Python worker uses just now, by the block's name.
_built: dict[str, list[SearchTable]] = {}


def _scanner(spark, items: list[tuple[str, bytes]], window: int):
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    @F.arrow_udf(HITS_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        claim("decontam", _built.clear)
        if name not in _built:
            _built.clear()
            _built[name] = build_tables(sent.value, window)
        rows = []
        for text in (t for _, run in some(texts) for t in run.to_pylist()):
            words = words_of(text)
            spans, ids = find(words, _built[name])
            rows.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(ids)})
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))]))

    # a filter on the result must not search a text once more
    return scan.asNondeterministic()


def _merged(lists: pa.Array) -> pa.Array:
    rows = []
    for spans in lists.to_pylist():
        spans = merge([(s["start"], s["stop"]) for s in spans])
        rows.append({"n_hit": sum(b - a for a, b in spans), "spans": [{"start": a, "stop": b} for a, b in spans]})
    return pa.array(rows, pa.struct([("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))


def mark_contaminated(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    out: str = "contamination",
    window: int = WINDOW,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """``docs`` with a struct column ``out`` of (n_words, n_hit, spans, items).

    A word is hit inside any occurrence of a window of ``window`` consecutive
    item words; an item with fewer words is one window. ``spans`` are merged
    word ranges, ``items`` the sorted ids (as text; a null id is the empty
    text) of items with an occurrence. Null and empty texts have no words and
    no hits; an empty benchmark hits nothing; repeated rows and item ids count
    as the rows and ids they are. A column already named ``out`` is replaced.

    Item texts up to ``table_bytes`` are broadcast as one table set. Larger
    benchmarks are dealt into blocks of about that size; each block is searched
    in all documents and the hits are merged by document.
    """
    spark = docs.sparkSession
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), utf8(F.col(item_text_col)).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = -(-total // table_bytes) or 1
    text = utf8(F.col(f"`{text_col}`"))
    if blocks == 1:
        return docs.withColumn(out, _scanner(spark, [(r.item, bytes(r.text)) for r in items.collect()], window)(text))
    # the hits depend on the text alone, so rows meet them by two hashes of it
    a, b, base, found, ids = fresh(docs, "key_a", "key_b", "base", "found", "ids")
    keyed = docs.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit(1), text)})
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        hit = _scanner(spark, [(r.item, bytes(r.text)) for r in own], window)(text)
        parts.append(keyed.select(a, b, hit.alias("h")).where("h.n_hit > 0").dropDuplicates([a, b]))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    hits = hits.groupBy(a, b).agg(F.flatten(F.collect_list("h.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias(ids))
    hits = hits.withColumn(found, F.arrow_udf(_merged, f"struct<n_hit:long,spans:{SPAN_TYPE}>")("spans")).select(a, b, found, ids)
    none = _scanner(spark, [], window)(text)
    joined = keyed.withColumn(base, none).join(hits, [a, b], "left")
    made = F.struct(
        F.col(f"{base}.n_words").alias("n_words"),
        F.coalesce(f"{found}.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(f"{found}.spans", F.array().cast(SPAN_TYPE)).alias("spans"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("items"),
    )
    return joined.withColumn(out, made).select(*[f"`{c}`" for c in docs.columns if c != out], out)


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark_contaminated(docs.select("doc_id", "text"), bench, out="c")
    return marked.select(
        "doc_id",
        "c.n_words",
        "c.n_hit",
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("c.n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns and any others, whatever their names.

    Null and empty texts have no hit and stay, equal rows share their fate, an
    empty benchmark keeps all rows and an empty table stays empty.
    """
    (out,) = fresh(docs, "contamination")
    return mark_contaminated(docs, bench, out=out).where(F.col(f"{out}.n_hit") == 0).drop(out)
