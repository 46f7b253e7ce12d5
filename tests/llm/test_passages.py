import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quillframe.llm import passages
from quillframe.llm.common import Workspace

SCHEMA = "doc_id long, text string, passages string, n_words string, _x string"


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "p", "n", "x") for i, t in rows], SCHEMA)


def cut(spark, rows):
    got = passages.dedup_passages(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "n_words", "_x", "passages"]
    return {r.doc_id: r for r in got.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_passages_inside_paragraphs(spark):
    rng = random.Random(1)
    rows, shared = [], [say(rng, n) for n in (52, 60, 90, 300)]
    for i in range(60):
        w = words(say(rng, 120))
        for k, p in enumerate(shared):
            if i % 6 == k:
                at = rng.randrange(len(w))
                w[at:at] = [p]
        rows.append((i, " ".join(w)))
    got = cut(spark, rows)
    for k, p in enumerate(shared):
        holders = [i for i in range(60) if i % 6 == k]
        assert p in got[holders[0]].text and got[holders[0]].passages.n_removed == 0
        for i in holders[1:]:
            n = got[i].passages.n_removed
            assert p not in got[i].text and passages.RUN <= n <= len(words(p)), (i, k, n)
            rest = rows[i][1].replace(p, " ")
            assert set(words(rest)) <= set(words(got[i].text)), "only words of the passage go"
    assert all(got[i].text == rows[i][1] for i in range(60) if i % 6 > 3)


def test_near_equal_paragraphs(spark):
    rng = random.Random(2)
    base = words(say(rng, 100))
    rows = []
    for i in range(25):
        w = list(base)
        if i:
            w[rng.randrange(100)] = f"new{i}"
        rows.append((i, f"{say(rng, 30)}\n{' '.join(w)}\n{say(rng, 30)}"))
    got = cut(spark, rows)
    assert got[0].text == rows[0][1]
    for i in range(1, 25):
        first, _, last = rows[i][1].split("\n")
        assert got[i].text == f"{first}\n{last}" and got[i].passages.n_removed == 100


def brute_classes(sets, bands):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        if (bands[i] == bands[j]).any():
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_classes_match_all_colliding_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        walk = words(say(rng, 60))
        for _ in range(30):
            walk = list(walk)
            for _ in range(rng.choice([1, 1, 2, 3])):
                walk[rng.randrange(60)] = say(rng, 1)
            texts.append(" ".join(walk))
    hashes = [passages.word_hashes([w.encode() for w in words(t)]) for t in texts]
    sets, ids = passages._paragraphs(np.concatenate(hashes), [(60 * i, 60 * i + 60) for i in range(len(texts))])
    bands = passages.band_keys(sets)
    want = brute_classes(sets, bands)
    assert 6 < len(set(want)) < len(texts)
    df = spark.createDataFrame([(int(k.view(np.int64)), s.tobytes(), b.view(np.int64).tolist()) for k, s, b in zip(ids, sets, bands)], "key long, shingles binary, bands array<long>")
    got = {r.node: r.component for r in passages.paragraph_classes(df, Workspace(spark, "t")).collect()}
    mine = [got.get(int(k.view(np.int64)), int(k.view(np.int64))) for k in ids]
    assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want)))


def test_crowded_buckets_meet_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(passages, "PAIRS", 0)
    monkeypatch.setattr(passages, "CELL", 3)
    seen = []
    meetings = passages._rare_meetings
    monkeypatch.setattr(passages, "_rare_meetings", lambda crowded, *a: seen.append(crowded.count()) or meetings(crowded, *a))
    test_classes_match_all_colliding_pairs(spark)
    assert seen[0] > 0


def test_bands_reach_similar_paragraphs():
    rng = random.Random(4)
    met = 0
    for _ in range(300):
        a = rng.getrandbits(60)
        rows = [np.unique(np.array([a + i for i in range(90)] + [rng.getrandbits(62) for _ in range(10)], np.uint64)) for _ in range(2)]
        keys = passages.band_keys(rows)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 295


def test_pieces_do_not_depend_on_their_place():
    rng = random.Random(5)
    p = [w.encode() for w in words(say(rng, 200))]
    keys = []
    for before in (0, 33, 150):
        h = passages.word_hashes([w.encode() for w in words(say(rng, before))] + p + [w.encode() for w in words(say(rng, 40))])
        keys.append(set(passages.piece_keys(h, passages.cuts(h)).tolist()))
    assert len(keys[0] & keys[1] & keys[2]) >= 15


def test_cut_out():
    assert passages.cut_out(b" a b  c d\ne f \n", [(1, 2)]) == (b" a c d\ne f \n", 1, 1)
    assert passages.cut_out(b"a b\nc d\ne", [(2, 4)]) == (b"a b\ne", 2, 1)
    assert passages.cut_out(b"a b\nc d\ne", [(0, 2), (1, 4), (4, 5)]) == (b"", 5, 1)
    assert passages.cut_out(b"a b c\nd", [(2, 3)]) == (b"a b\nd", 1, 1)
    assert passages.cut_out(b"a b c", [(1, 3)]) == (b"a", 2, 1)


def test_edges(spark):
    rng = random.Random(6)
    t, u = say(rng, 80), say(rng, 90)
    rows = [(5, t), (5, u), (7, t), (7, t), (None, u), (8, None), (9, ""), (10, "the " * 60000), (11, "the " * 50000), (12, "x y"), (13, t + "\n" + t)]
    got = passages.dedup_passages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[None] == [u] and by[8] == [None] and by[9] == [""] and by[12] == ["x y"]
    assert sorted(by[5]) == sorted([t, ""]) and by[7] == ["", ""] and by[13] == [""]
    assert passages.report(frame(spark, rows[:0])).collect() == []
    assert passages.report(frame(spark, rows)).columns == ["doc_id", "text", "n_words", "n_removed", "n_spans", "changed"]


def test_short_paragraphs_are_compared(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k, n in enumerate((21, 24, 30, 39)):
        line = words(say(rng, n))
        for m, edit in enumerate((line, line[:-1] + ["edited"], line + ["added"], ["added"] + line)):
            both, all_ = len(line) - 4 - (m == 1), len(line) - 4 + (m > 0)
            assert both >= 0.8 * all_
            i = 10 * k + m
            rows.append((i, say(rng, 30) + "\n" + " ".join(edit) + "\n" + say(rng, 30)))
            want[i] = len(edit) if m else 0
    got = cut(spark, rows)
    assert {i: r.passages.n_removed for i, r in got.items()} == want


def test_words_of_a_text_are_hashed_at_once():
    rng = random.Random(6)
    texts = [b"", b"\n\n", b"A b\x0bC", *(bytes(rng.choice(b"aB \n\t\x0b\xc3\xa9\x00\x1c|") for _ in range(rng.randint(0, 900))) for _ in range(60))]
    texts.append(b" ".join(bytes(rng.randrange(33, 256) for _ in range(n)) for n in range(1, 90)))
    got = passages.Texts(texts)
    found = [line.split() for text in texts for line in text.lower().split(b"\n")]
    assert got.hashes.tolist() == [xxhash.xxh64_intdigest(w) for line in found for w in line]
    assert np.diff(got.starts).tolist() == [len(t.split()) for t in texts]
    assert (got.lines[:, 1] - got.lines[:, 0]).tolist() == [len(line) for line in found if len(line) >= passages.RUN]
    assert got.line_text.tolist() == [i for i, t in enumerate(texts) for line in t.split(b"\n") if len(line.split()) >= passages.RUN]


def test_workers_remember_no_words():
    texts = [" ".join(f"{i}w{j}" for j in range(1000)).encode() for i in range(50)]
    passages.Texts(texts)
    tracemalloc.start()
    passages.Texts([t.replace(b"w", b"v") for t in texts])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20
