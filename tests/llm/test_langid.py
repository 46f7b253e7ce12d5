import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillframe.llm import langid
from quillframe.llm.common import Workspace, table

SCHEMA = "doc_id long, text string, lang string, lid string, score string"


def brute_model(by_lang):
    """Interpolated Kneser-Ney from its definition, over dictionaries."""
    models = {}
    for lang, texts in by_lang.items():
        top = Counter(int(g) for t in texts for g in langid.grams(t.encode()))
        counts = {4: top}
        for k in (3, 2, 1):
            counts[k] = Counter(g & (1 << 8 * k) - 1 for g in counts[k + 1])
        models[lang] = counts
    return models


def brute_logp(counts, gram):
    p = 1 / 256
    for k in (1, 2, 3, 4):
        g = gram & (1 << 8 * k) - 1
        c = counts[k]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice) if once and twice else 0.75
        same = [v for h, v in c.items() if h >> 8 == g >> 8]
        if same:
            p = max(c.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p
    return math.log2(p)


def texts():
    return {"xx": ["the cat, the hat", "that THE 12 Ünder"], "yy": ["der die das und", "und  der Übel ñ"]}


def test_probabilities_match_definition():
    by_lang = texts()
    langs = sorted(by_lang)
    rows = [(i, int(g)) for i, lang in enumerate(langs) for t in by_lang[lang] for g in langid.grams(t.encode())]
    model = langid.LanguageModel.build(langs, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.ones(len(rows), np.int64))
    codes = np.concatenate([langid.grams(b"the und der cats \xc3\x9cnx zz"), np.array([1 << 24 | 250, 7 << 16 | 7], np.uint32)])
    got = model.log_probabilities(codes)
    for i, counts in enumerate(brute_model(by_lang)[x] for x in langs):
        assert np.allclose(got[:, i], [brute_logp(counts, int(c)) for c in codes], atol=1e-4)


def test_probabilities_sum_to_one():
    by_lang = texts()
    langs = sorted(by_lang)
    rows = [(i, int(g)) for i, lang in enumerate(langs) for t in by_lang[lang] for g in langid.grams(t.encode())]
    model = langid.LanguageModel.build(langs, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.ones(len(rows), np.int64))
    for context in (0, int(langid.grams(b"the")[2]), 0x01020304 & 0xFFFFFF):
        codes = np.array([context << 8 & 0xFFFFFFFF | s for s in range(256)], np.uint32)
        assert np.allclose(np.exp2(model.log_probabilities(codes)).sum(axis=0), 1, atol=1e-3)


def frame(spark):
    rng = random.Random(1)
    vocab = {"xx": "the of and there thing that".split(), "yy": "der und die schön nicht Öl".split()}
    rows = [(i, " ".join(rng.choice(vocab[x]) for _ in range(20)), x, "a", "b") for i, x in enumerate(["xx", "yy"] * 60)]
    rows += [(500, None, "xx", "a", "b"), (501, "12 !! \n", "yy", "a", "b"), (502, "", None, "a", "b"), (None, "the thing of that", None, "a", "b"), (503, "der " * 60000, None, "a", "b"), (1, rows[1][1], "yy", "a", "b"), (1, rows[1][1], "yy", "a", "b")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_evaluate(spark):
    df, rows = frame(spark)
    got = langid.evaluate(df, Workspace(spark, "t")).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert all(r.lang_pred == rows[r.doc_id][2] for i in range(120) for r in by_id[i])
    assert {by_id[i][0].lang_pred for i in (500, 501, 502)} == {"und"}
    assert by_id[None][0].lang_pred == "xx" and by_id[503][0].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_keep_and_reject(spark):
    df, rows = frame(spark)
    odd = spark.createDataFrame([(900, "qzx jqk vvx kqj zzq xqz qqj" * 4, None, "a", "b")], SCHEMA)
    kept = langid.keep_identified(df.union(odd))
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {500, 501, 502, 900} & set(ids) and len(ids) == len(rows) - 3


def test_nothing_to_learn(spark):
    df, _ = frame(spark)
    got = langid.evaluate(df.withColumn("lang", df.lang.substr(9, 1)).where("lang = 'never'"), Workspace(spark, "t"))
    assert got.count() == 0
    assert langid.score(df, None).where("lid.lang_pred <> 'und'").count() == 0
    assert langid.keep_identified(df.limit(0)).count() == 0


def test_step_sizes_agree(spark, monkeypatch):
    df, _ = frame(spark)
    whole = {(r.lang, r.gram): r.n for r in langid.count_grams(df, "lang", "text").collect()}
    model = langid.train(df)
    bits, sizes = model.cross_entropies(pa.array([b"the thing " * 50, b"", b"und"]))
    monkeypatch.setattr(langid, "STEP", 37)
    run = model.cross_entropies(pa.array([b"the thing " * 50, b"", b"und"]))
    assert np.allclose(bits, run[0]) and (sizes == run[1]).all()
    assert sum(whole.values()) == sum(len(langid.grams((r.text or "").encode())) for r in df.where("lang IS NOT NULL").collect())


@pytest.mark.parametrize("share", [0.05, 0.15, 0.3])
def test_groups_of_bad_texts_are_rejected(spark, share):
    rng = random.Random(3)
    vocab = "the of and there thing that with have this from they would what about which when make like time just".split()
    good = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(10, 60))), rng.choice(["xx", "xx", None]), "a", "b") for i in range(600)]
    bad = int(len(good) * share / (1 - share))
    junk = [(10_000 + i, "".join(rng.choice("bcdfgjkqvwxz ") for _ in range(rng.randint(60, 300))), None, "a", "b") for i in range(bad)]
    df = spark.createDataFrame(good + junk, SCHEMA)
    assert {r.doc_id for r in langid.keep_identified(df).collect()} == {r[0] for r in good}


def test_shards_hold_every_count(spark):
    df, rows = frame(spark)
    odd = spark.createDataFrame([(700 + i, "zażółć gęślą %s jaźń" % chr(0x4E00 + i), "zz", "a", "b") for i in range(3)], SCHEMA)
    df = df.union(odd).where("doc_id <> 503")
    by_lang = defaultdict(list)
    for r in df.where("lang IS NOT NULL").collect():
        by_lang[r.lang].append(r.text or "")
    brute = brute_model(by_lang)
    texts = ["the der zażółć 丂 there", "", "nicht Öl", "zz qq"]
    for size in (None, 60, 3):
        model = langid.train(df, shard_size=size)
        assert model.langs == sorted(brute) and (len(model.sent) > 1) == (size is not None)
        bits, sizes = model.cross_entropies(pa.array([t.encode() for t in texts]))
        scored = langid.score(spark.createDataFrame([(t,) for t in texts], "text string"), model)
        least = {r.text: r.lid.xent for r in scored.collect()}
        for t, got, n in zip(texts, bits, sizes):
            want = [-sum(brute_logp(brute[x], int(g)) for g in langid.grams(t.encode())) / max(n, 1) for x in model.langs]
            assert np.allclose(got, want, atol=1e-3)
            assert least[t] is None if not n else abs(least[t] - min(want)) < 1e-3


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.evaluate(docs, Workspace(spark, "t")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert right / n > 0.97
    assert got.where("rejected").count() / n < 0.01
