"""Quality rules: base counts and the divergence of a text from its language's reference.

References come from all documents of a language: the shares of nine character
classes, and the shares of its common words (each at least ``COMMON`` of all
words, so at most 1/``COMMON`` of them) with all other words as one class. The
common words are found exactly in two passes: words are first counted in hashed
buckets, and then only the words of heavy buckets are counted by themselves.
A document is compared by Jensen-Shannon distance (square root, base 2: 0 to 1),
each histogram only above a least length.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Workspace, map_batches, utf8
from quillframe.llm.decontam import words_of

#: Fixed by the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50

CLASSES = ("lower", "upper", "letter", "digit", "space", "sentence", "symbol", "mark", "other")
SENTENCE = ".,;:!?'\"()-’“”«»¿¡…。，、"
#: Least share of a language's words that makes a word common.
COMMON = 1 / 1000
BUCKETS = 1 << 14
#: Least code points and words for the two comparisons.
LEAST_CHARS_COMPARED = 200
LEAST_WORDS_COMPARED = 150
#: Largest distances of a document that is kept.
CHAR_DISTANCE = 0.28
WORD_DISTANCE = 0.42

_classes: list[np.ndarray] = []


def _class_of(c: str) -> int:
    kind = unicodedata.category(c)
    if c.isspace():
        return 4
    if c in SENTENCE:
        return 5
    if c in SYMBOLS.decode():
        return 6
    return {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Mn": 2, "Mc": 2, "Nd": 3}.get(kind, 7 if kind[0] in "PSN" else 8)


def char_classes(text: bytes) -> np.ndarray:
    """Code points of each class."""
    if not _classes:
        _classes.append(np.array([_class_of(chr(c)) for c in range(0x110000)], np.uint8))
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    return np.bincount(_classes[0][points], minlength=len(CLASSES))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    key = ids[:n]
    for shift in range(1, size):
        if shift > 1 and len(number) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[shift : shift + n]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(size):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    points = len(text.decode("utf-8", "replace"))
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), points - spaces, sum(text.count(bytes([c])) for c in SYMBOLS), again, repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 where either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = sum(np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q))
    return float(np.sqrt(max(0.0, total / 2)))


class References:
    """By language: character classes, and common words with their histogram (the last bin holds all others)."""

    def __init__(self, chars: dict[str, np.ndarray], words: dict[str, dict[bytes, int]], totals: dict[str, int]):
        self.chars = chars
        self.words = {lang: {w: i for i, w in enumerate(sorted(found))} for lang, found in words.items()}
        self.shares = {lang: np.array([*(found[w] for w in sorted(found)), totals[lang] - sum(found.values())], float) for lang, found in words.items()}

    def distances(self, lang: str | None, text: bytes) -> tuple[str | None, float, float]:
        """The language compared with and both distances; without a reference of its own the nearest language."""
        n_chars, found = char_classes(text), words_of(text)
        counts = Counter(found)
        best = None
        for name in [lang] if lang in self.chars else sorted(self.chars):
            index = self.words[name]
            bins = np.zeros(len(index) + 1)
            for word in index.keys() & counts.keys():
                bins[index[word]] = counts[word]
            bins[-1] = len(found) - bins.sum()
            both = (distance(n_chars, self.chars[name]) if n_chars.sum() >= LEAST_CHARS_COMPARED else 0.0, distance(bins, self.shares[name]) if len(found) >= LEAST_WORDS_COMPARED else 0.0)
            if best is None or sum(both) < sum(best[1:]):
                best = (name, *both)
        return best or (None, 0.0, 0.0)


def _word_counts(batch: pa.RecordBatch):
    by_lang: dict[str, Counter] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by_lang.setdefault(lang, Counter()).update(words_of(text))
    return by_lang


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> References:
    """References of all languages named in ``lang_col``, from every row that names one; null texts add nothing."""
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), utf8(F.col(text_col)).alias("text"))

    def tally(batch: pa.RecordBatch):
        out = []
        for lang, counts in _word_counts(batch).items():
            sums = np.zeros(BUCKETS, np.int64)
            for word, n in counts.items():
                sums[zlib.crc32(word) % BUCKETS] += n
            out += [(lang, i, n) for i, n in enumerate(sums.tolist()) if n]
        chars: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chars[lang] = chars.get(lang, 0) + char_classes(text)
        out += [(lang, -1 - i, n) for lang, sums in chars.items() for i, n in enumerate(sums.tolist())]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["lang", "bin", "n"])

    ws = Workspace(spark, "rules")
    bins = ws.save(map_batches(rows, tally, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "bins")
    totals = {r.lang: r.n for r in bins.groupBy("lang").agg(F.sum(F.when(F.col("bin") >= 0, F.col("n")).otherwise(0)).alias("n")).collect()}
    limit = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(v * COMMON))]) if totals else None
    chars: dict[str, np.ndarray] = {lang: np.zeros(len(CLASSES), np.int64) for lang in totals}
    heavy: dict[str, set[int]] = {lang: set() for lang in totals}
    # at most 1/COMMON buckets of a language reach that share
    for r in bins.where((F.col("bin") < 0) | (F.col("n") >= limit[F.col("lang")])).collect() if totals else []:
        if r.bin < 0:
            chars[r.lang][-1 - r.bin] = r.n
        else:
            heavy[r.lang].add(r.bin)
    sent = spark.sparkContext.broadcast(heavy)

    def count(batch: pa.RecordBatch):
        out = [(lang, word, n) for lang, counts in _word_counts(batch).items() for word, n in counts.items() if zlib.crc32(word) % BUCKETS in sent.value[lang]]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    words: dict[str, dict[bytes, int]] = {lang: {} for lang in totals}
    if totals:
        exact = map_batches(rows, count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        for r in exact.where(F.col("n") >= limit[F.col("lang")]).collect():
            words[r.lang][bytes(r.word)] = r.n
    ws.close()
    return References(chars, words, totals)


RESULT = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,kept:boolean,reference:string,char_distance:double,word_distance:double>"


def judge(docs: DataFrame, refs: References, lang_col: str = "lang", text_col: str = "text", out: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``out`` of the base counts, the verdicts and both distances.

    ``kept`` is false where the base rules fail or a distance that is compared
    exceeds its limit. Null and empty texts have zero counts and fail. A null
    or unknown language is compared with the nearest reference; without any
    reference only the base rules count. Rows are judged one by one, repeated
    ones alike. A column already named ``out`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(refs)
    names = [x.split(":")[0] for x in RESULT[7:-1].split(",")]

    @F.arrow_udf(RESULT)
    def run(langs: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for lang, text in zip(langs.to_pylist(), texts.to_pylist()):
            counts = base_counts(text)
            failed = base_failed(counts[0], counts[4])
            name, by_char, by_word = sent.value.distances(lang, text)
            rows.append((*counts, failed, not failed and by_char <= CHAR_DISTANCE and by_word <= WORD_DISTANCE, name, by_char, by_word))
        cols = list(zip(*rows)) or [()] * len(names)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.float64(), pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return docs.withColumn(out, run(F.col(f"`{lang_col}`").cast("string"), utf8(F.col(f"`{text_col}`"))))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and the distances."""
    rows = docs.select("doc_id", "text", "lang")
    return judge(rows, references(rows)).select("doc_id", "rules.*")
