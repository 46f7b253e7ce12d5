import hashlib
import random
import re

from quillframe.llm import decontam


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench, window=10):
    out = []
    for doc_id, text in docs:
        words = words_of(text)
        hit, items = set(), set()
        for item, item_text in bench:
            w = words_of(item_text)
            size = min(window, len(w))
            for a in range(len(w) - size + 1 if w else 0):
                for b in range(len(words) - size + 1):
                    if words[b : b + size] == w[a : a + size]:
                        hit |= set(range(b, b + size))
                        items.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(items), digest, bool(hit)))
    return sorted(out, key=str)


def tables(seed=5):
    rng = random.Random(seed)
    vocab = ["the", "of", "Éa", "x1", "b", "it's", "ünd", "10"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, say(rng.choice([1, 2, 3, 9, 10, 11, 25]) + (0 if i % 3 else 4))) for i in range(40)]
    bench += [(7, bench[7][1]), (None, say(12)), (90, None), (91, "... !!"), (92, "THE   the"), (93, "a " * 30)]
    docs = []
    for i in range(60):
        text = say(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(bench)[1] or ""
            text += rng.choice([" ", "\n", ", "]) + rng.choice([item.upper(), item[: len(item) // 2], item]) + " " + say(3)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (None, docs[5][1]), (5, docs[5][1]), (5, docs[5][1]), (102, "a " * 500), (103, "Of the " * 30000)]
    return docs, bench


def result(spark, docs, bench, **options):
    d = spark.createDataFrame([(i, t, "n", "m") for i, t in docs], "doc_id long, text string, n_words string, contamination string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    return d, b


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_report_matches_brute_force(spark):
    docs, bench = tables()
    d, b = result(spark, docs, bench)
    assert rows(decontam.report(d, b)) == brute(docs, bench)


def test_blocks_give_the_same(spark):
    docs, bench = tables(6)
    d, b = result(spark, docs, bench)
    whole = decontam.mark_contaminated(d, b)
    parts = decontam.mark_contaminated(d, b, table_bytes=400)
    assert parts.columns == whole.columns
    assert rows(parts) == rows(whole)


def test_drop_keeps_columns_and_clean_rows(spark):
    docs, bench = tables()
    d, b = result(spark, docs, bench)
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns
    clean = sorted((r[0] for r in brute(docs, bench) if not r[5]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == clean


def test_empty_tables(spark):
    docs, bench = tables()
    d, b = result(spark, docs, bench)
    assert decontam.report(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontam.report(d, b.limit(0)).collect()} == {0}
