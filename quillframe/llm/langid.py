"""Language identification by interpolated Kneser-Ney character models.

One model of order four per language over a small alphabet: ``a`` to ``z``, 229
classes of all other letters, and one mark for any run of other characters. An
n-gram's hash is its symbols packed into 32 bits. All languages share sorted
arrays of hashes, one array per order, with a row of log probabilities (one per
language) beside each hash and the back-off weights of each context; a text is
scored for all languages by binary search in these arrays.

The counts come from all training rows, summed where they lie before they are
shuffled, and every one of them is in the model. A model is built and searched
in shards by the two middle symbols of the n-grams: the contexts, the shorter
n-grams and the continuation counts of order three lie in the same shard, and
what is shorter is in all of them. The driver and each worker hold one shard at
a time. The prediction is the language of least cross-entropy per symbol. A
prediction is rejected where its cross-entropy exceeds the median of rows of
like length whose language is known to be this one, and which a model learned
without them has scored, by ``REJECT_SD`` robust standard deviations and what a
short text varies by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Workspace, claim, fresh, some, utf8

ORDER = 4
#: Entries (n-grams of the highest order times languages) of a shard; more n-grams make more shards.
SHARD = 8_000_000
#: Symbols counted in one step, and symbols scored in one step (each takes about a hundred bytes meanwhile).
STEP, SCORED = 1 << 20, 1 << 17
#: Different n-grams, times languages, that a task counts before it sends their sums on.
SUMS = 1 << 20
#: Standard deviations (from the median absolute deviation) above the median of the calibration rows at which a prediction is rejected.
REJECT_SD = 6.0
#: Bits over the square root of the symbols that a limit is higher by: three standard errors of a mean of symbols that vary by 2.5 bits.
SAMPLING = 7.5
#: One in so many texts is for calibration.
FOLDS = 5
#: Calibration texts that a class of length must have to be calibrated by itself.
CLASS_ROWS = 30
#: Pairs of middle symbols.
CELLS = 1 << 16
UNKNOWN = "und"

_alphabet: list[np.ndarray] = []


def alphabet() -> np.ndarray:
    """The symbol of every code point: 0 for what is no letter."""
    if not _alphabet:
        table = np.array([27 + c % 229 if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint8)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _alphabet.append(table)
    return _alphabet[0]


def symbols(text: bytes) -> np.ndarray:
    """Symbols of a text in lower case, runs of other characters as one mark; empty without a letter."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), "<u4")
    s = alphabet()[points]
    if not s.any():
        return s[:0]
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    return s[keep]


def grams(text: bytes) -> np.ndarray:
    """Hashes of the n-grams of highest order, one ending at each symbol; a mark stands before and after the text."""
    s = symbols(text)
    if not len(s):
        return np.zeros(0, np.uint32)
    s = np.concatenate([np.zeros(ORDER - 1, np.uint8), s, np.zeros(int(s[-1] > 0), np.uint8)]).astype(np.uint32)
    return s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:]


def count_grams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``(lang, gram, n)`` over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        waiting: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle() -> None:
            for lang, pending in waiting.items():
                found, n = np.unique(np.concatenate(pending), return_counts=True)
                if lang in sums:
                    old, m = sums[lang]
                    both, at = np.unique(np.concatenate([old, found]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([m, n]), len(both)).astype(np.int64)
                    found = both
                sums[lang] = found, n
            waiting.clear()

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, (found, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            sums.clear()

        size = 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in some(batch.column(1)):
                for lang, text in zip(langs[at:], texts.to_pylist()):
                    g = grams(text)
                    waiting.setdefault(lang, []).append(g)
                    size += len(g)
                    if size > STEP:
                        settle()
                        size = 0
            if sum(len(found) for found, _ in sums.values()) > SUMS:
                yield from counted()
        settle()
        yield from counted()

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), utf8(F.col(text_col)).alias("text"))
    parts = rows.mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    return _discount_of((counts == 1).sum(), (counts == 2).sum())


def _discount_of(once: int, twice: int) -> float:
    return float(once / (once + 2 * twice)) if once and twice else 0.75


@dataclass
class Whole:
    """What the shards of a model share: counts of pairs (sorted codes, a column per language), discounts of orders three and four."""

    pairs: tuple[np.ndarray, np.ndarray]
    discounts: dict[int, np.ndarray]


@dataclass
class LanguageModel:
    """Sorted hashes by order, and log probabilities and back-off weights by language."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    #: The middle symbols of the n-grams that are searched here, from and to.
    cells: tuple[int, int] = (0, CELLS)

    @classmethod
    def build(cls, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, cells: tuple[int, int] = (0, CELLS), whole: Whole | None = None) -> LanguageModel:
        """From the counts of n-grams of highest order: ``lang`` numbers the language of each.

        Counts of some ``cells`` only need what the ``whole`` corpus says.
        """
        top, at = np.unique(gram.astype(np.uint32), return_inverse=True)
        counts = np.zeros((len(top), len(langs)), np.float64)
        np.add.at(counts, (at, lang), n)
        keys, table = [top], [counts]
        for order in range(ORDER - 1, 0, -1):
            # continuation counts: how many different symbols stand before
            shorter = keys[0] & np.uint32((1 << 8 * order) - 1)
            if order == 2 and whole:
                found, counts = whole.pairs
            else:
                found = np.unique(shorter) if order > 1 else np.arange(256, dtype=np.uint32)
                counts = np.zeros((len(found), len(langs)))
                np.add.at(counts, np.searchsorted(found, shorter), table[0] > 0)
            keys.insert(0, found)
            table.insert(0, counts)
        logp, contexts, backoff = [], [], []
        below = np.full((1, len(langs)), 1 / 256)
        for order, (found, counts) in enumerate(zip(keys, table), 1):
            context, at = np.unique(found >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((2, len(context), len(langs)))
            np.add.at(total, at, counts)
            np.add.at(kinds, at, counts > 0)
            d = whole.discounts[order] if whole and order > 2 else np.array([_discount(counts[:, i]) for i in range(len(langs))])
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            suffix = np.zeros(len(found), np.int64) if order == 1 else np.searchsorted(keys[order - 2], found & np.uint32((1 << 8 * (order - 1)) - 1))
            p = np.maximum(counts - d, 0) / np.maximum(total[at], 1) + weight[at] * below[suffix]
            logp.append(np.log2(p).astype(np.float32))
            contexts.append(context)
            backoff.append(np.log2(weight).astype(np.float32))
            below = p
        return cls(langs, keys, logp, contexts, backoff, cells)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """A row per n-gram, a column per language."""
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        left, code = np.arange(len(codes)), codes
        for order in range(ORDER, 0, -1):
            keys = self.keys[order - 1]
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            found = keys[at] == code
            if found.all():
                out[left] += self.logp[order - 1][at]
                break
            out[left[found]] += self.logp[order - 1][at[found]]
            left, code = left[~found], code[~found]
            context = code >> np.uint32(8)
            contexts = self.contexts[order - 1]
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            out[left[known]] += self.backoff[order - 1][at[known]]
            code = code & np.uint32((1 << 8 * (order - 1)) - 1)
        return out

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the n-grams in this shard's cells by text and language, and all symbols of each text."""
        bits = np.zeros((len(texts), len(self.langs)))
        sizes = np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0

        def settle() -> None:
            codes = np.concatenate([g for _, g in waiting])
            values = self.log_probabilities(codes)
            starts = np.cumsum([0] + [len(g) for _, g in waiting[:-1]])
            sums = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
            np.add.at(bits, [i for i, _ in waiting], -sums)
            waiting.clear()

        for i, text in enumerate(text for _, run in some(texts) for text in run.to_pylist()):
            g = grams(text)
            sizes[i] = len(g)
            if self.cells != (0, CELLS):
                cell = g >> np.uint32(8) & np.uint32(CELLS - 1)
                g = g[(cell >= self.cells[0]) & (cell < self.cells[1])]
            for at in range(0, len(g), SCORED):
                waiting.append((i, g[at : at + SCORED]))
                size += len(waiting[-1][1])
                if size >= SCORED:
                    settle()
                    size = 0
        if waiting:
            settle()
        return bits, sizes


@dataclass
class Shards:
    """A model in broadcast shards."""

    langs: list[str]
    sent: list[Broadcast]

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by text and language, and the symbols of each text."""
        bits = 0.0
        for shard in self.sent:
            own, sizes = shard.value.bits(texts)
            bits = bits + own
            if len(self.sent) > 1:
                # the next one takes its place; it is read again from the worker's disk
                del shard._value
        return bits / np.maximum(sizes, 1)[:, None], sizes


def _whole(counts: DataFrame, langs: list[str]) -> Whole:
    """From all counts: continuation counts of pairs and the discounts, which need every n-gram of their order."""

    def low(order: int):
        return F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")

    index = {name: i for i, name in enumerate(langs)}
    triples = counts.groupBy("lang", low(3)).agg(F.count(F.lit(1)).alias("n"))
    discounts = {}
    for order, rows in ((4, counts), (3, triples)):
        discounts[order] = np.full(len(langs), 0.75)
        for r in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
            discounts[order][index[r.lang]] = _discount_of(r.once, r.twice)
    pairs = triples.groupBy("lang", low(2)).agg(F.count(F.lit(1)).alias("n")).toArrow()
    found, at = np.unique(pairs["gram"].to_numpy().astype(np.uint32), return_inverse=True)
    table = np.zeros((len(found), len(langs)))
    table[at, _numbers(pairs["lang"], langs)] = pairs["n"].to_numpy()
    return Whole((found, table), discounts)


def _numbers(names: pa.ChunkedArray, langs: list[str]) -> np.ndarray:
    return pc.index_in(names, pa.array(langs, pa.string())).to_numpy().astype(np.int64)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_size: int | None = None) -> Shards | None:
    """A model of all languages named in ``lang_col``; None if no row names one or has a letter.

    Rows without a language or a letter add nothing; repeated rows count as
    often as they occur. No count is left out: ``shard_size`` bounds what the
    driver and a worker hold at once, not the model.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "langid")
    counts = ws.save(count_grams(docs, lang_col, text_col), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        ws.close()
        return None
    whole = _whole(counts, langs)
    cell = F.shiftright("gram", 8).bitwiseAND(F.lit(CELLS - 1))
    sizes = np.zeros(CELLS, np.int64)
    for r in counts.groupBy(cell.alias("cell")).count().collect():
        sizes[r.cell] = r["count"]
    most = (SHARD if shard_size is None else shard_size) // len(langs)
    starts, size = [0], 0
    for i in np.flatnonzero(sizes).tolist():
        if size and size + sizes[i] > most:
            starts.append(i)
            size = 0
        size += sizes[i]
    sent = []
    for first, after in zip(starts, [*starts[1:], CELLS]):
        got = counts.where((cell >= first) & (cell < after)).toArrow()
        model = LanguageModel.build(langs, _numbers(got["lang"], langs), got["gram"].to_numpy(), got["n"].to_numpy(), (first, after), whole)
        sent.append(spark.sparkContext.broadcast(model))
    ws.close()
    return Shards(langs, sent)


def score(docs: DataFrame, model: Shards | None, text_col: str = "text", out: str = "lid") -> DataFrame:
    """``docs`` with a struct column ``out`` of (lang_pred, score, xent, n_symbols).

    ``score`` is the posterior of the prediction among the languages, from the
    cross-entropies of at most 50 symbols' worth, 0 to 1. A text that is null,
    empty or has no letter, or any text without a model, gets ``und``, score 0
    and a null cross-entropy. Ties go to the first language by name. A column
    already named ``out`` is replaced.
    """
    @F.arrow_udf("struct<lang_pred:string,score:double,xent:double,n_symbols:long>")
    def run(texts: pa.Array) -> pa.Array:
        claim("langid")
        if model is None:
            sizes = np.array([len(grams(t)) for _, run in some(texts) for t in run.to_pylist()], np.int64)
            langs, best, posterior, there = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        else:
            bits, sizes = model.cross_entropies(texts)
            there = sizes > 0
            which = bits.argmin(axis=1)
            best = bits[np.arange(len(bits)), which]
            odds = np.exp2(-(bits - best[:, None]) * np.minimum(sizes, 50)[:, None]).sum(axis=1)
            posterior = np.where(there, 1 / odds, 0.0)
            langs = [model.langs[i] if ok else UNKNOWN for i, ok in zip(which, there)]
        cols = [pa.array(langs, pa.string()), pa.array(posterior, pa.float64()), pa.array(best, pa.float64(), mask=~there), pa.array(sizes)]
        return pa.StructArray.from_arrays(cols, ["lang_pred", "score", "xent", "n_symbols"])

    # a filter on the result must not score a text once more
    return docs.withColumn(out, run.asNondeterministic()(utf8(F.col(f"`{text_col}`"))))


def _length_class(n):
    return F.floor(F.log2(n + F.lit(1)))


def _typical(rows: DataFrame, *keys: str) -> DataFrame:
    """Median ``mid`` of ``x``, median absolute deviation ``mad`` and count ``n`` by keys."""

    def median(x):
        return F.percentile_approx(x, 0.5, 10_000)

    mids = rows.groupBy(*keys).agg(median(F.col("x")).alias("mid"), F.count(F.lit(1)).alias("n"))
    off = rows.join(F.broadcast(mids), list(keys))
    return off.groupBy(*keys).agg(median(F.abs(F.col("x") - F.col("mid"))).alias("mad"), F.first("mid").alias("mid"), F.first("n").alias("n"))


def calibrate(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang_pred, class, most)``: the cross-entropy above which a long text's prediction is rejected, from training rows.

    A model of the other texts scores one text in ``FOLDS``, by hash; those
    whose prediction is their language count, each once, however often they
    occur. Medians keep bad texts among them from widening the limits. One row
    per language and class of length (powers of two) with ``CLASS_ROWS`` texts,
    and one per language with a null class for the rest. A class spreads at least as its
    language does, so that a group of near copies does not narrow it. A
    language without such texts has no limit.
    """
    ws = Workspace(docs.sparkSession, "langid")
    lang, text = F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{text_col}`").alias("_text")
    rows = docs.select(lang, text, F.xxhash64(utf8(text)).alias("_key")).where("_lang IS NOT NULL")
    own = F.pmod(F.col("_key"), F.lit(FOLDS)) == 0
    scored = score(rows.where(own), train(rows.where(~own), "_lang", "_text"), "_text", "_lid").where("_lid.lang_pred = _lang AND _lid.xent IS NOT NULL")
    seen = scored.select("_lid.lang_pred", _length_class(F.col("_lid.n_symbols")).alias("class"), F.col("_lid.xent").alias("x"), "_key")
    seen = ws.save(seen.groupBy("_key", "lang_pred").agg(F.first("class").alias("class"), F.first("x").alias("x")), "calibration")
    whole = _typical(seen, "lang_pred")
    fine = _typical(seen, "lang_pred", "class").where(F.col("n") >= CLASS_ROWS).join(F.broadcast(whole.select("lang_pred", F.col("mad").alias("all_mad"))), "lang_pred")
    sd = REJECT_SD * 1.4826
    fine = fine.select("lang_pred", "class", (F.col("mid") + sd * F.greatest("mad", "all_mad") + F.lit(0.05)).alias("most"))
    return fine.unionByName(whole.select("lang_pred", F.lit(None).cast("bigint").alias("class"), (F.col("mid") + sd * F.col("mad") + F.lit(0.05)).alias("most")))


def mark_rejected(scored: DataFrame, limits: DataFrame, out: str = "lid", flag: str = "rejected") -> DataFrame:
    """``scored`` with a boolean ``flag``: no letter, or a cross-entropy above the limit of its language and length."""
    rows = limits.collect()  # one per language and power of two
    cases = F.create_map(*[x for r in rows for x in (F.lit(f"{r.lang_pred} {'' if r['class'] is None else r['class']}"), F.lit(r.most))]) if rows else None
    lid = F.col(f"{out}.lang_pred")
    if cases is None:
        return scored.withColumn(flag, F.col(f"{out}.n_symbols") == 0)
    own = F.try_element_at(cases, F.concat_ws(" ", lid, _length_class(F.col(f"{out}.n_symbols")).cast("string")))
    limit = F.coalesce(own, F.try_element_at(cases, F.concat(lid, F.lit(" "))))
    limit += F.lit(SAMPLING) / F.sqrt(F.greatest(F.col(f"{out}.n_symbols"), F.lit(1)))
    return scored.withColumn(flag, (F.col(f"{out}.n_symbols") == 0) | F.coalesce(F.col(f"{out}.xent") > limit, F.lit(False)))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether a document's id falls in the fold that is not learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def evaluate(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, xent, rejected; learned and calibrated on the other folds."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    training = rows.where("NOT held_out")
    scored = score(rows.drop("lang"), train(training)).drop("text")
    return mark_rejected(scored, calibrate(training)).select("doc_id", "held_out", "lid.lang_pred", "lid.score", "lid.xent", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns and any others; learned and calibrated on those that name a language.

    Null and empty texts and texts without a letter are rejected. Equal rows
    share their fate; where no row names a language, every text with a letter
    stays. An empty table stays empty. Column names may be any.
    """
    lid, rejected = fresh(docs, "lid", "rejected")
    scored = score(docs, train(docs), out=lid)
    marked = mark_rejected(scored, calibrate(docs), lid, rejected)
    return marked.where(~F.col(rejected)).drop(lid, rejected)
