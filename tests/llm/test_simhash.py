import random
import re

import pytest
import xxhash

from quillframe.llm import simhash
from quillframe.llm.common import Workspace
from quillframe.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, u string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    comp = brute_components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in fps:
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    return sorted(((d, f"{f:016x}", least.get(comp[f])) for d, f in fps), key=str)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}É"[: rng.randint(2, 9)] for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 40, 200]))]
        rows.append((i, " ".join(words)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(250, 1)
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, rows[3][1]), (5, rows[7][1]), (5, rows[7][1]), (903, "One TWO"), (904, "one two"), (905, "a b c d")]
    rows.append((906, "long word " * 40000))
    assert result(spark, rows) == brute(rows)


def test_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 3)
    rows = corpus(200, 2)
    base = rows[10][1].split(" ") + ["tail"] * 3
    rows += [(1000 + i, " ".join(base + [f"z{i}"])) for i in range(60)]
    assert result(spark, rows) == brute(rows)


def test_links_of_planted_bits(spark, monkeypatch):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps |= {f, f ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), f ^ 7 << rng.randrange(60)}
    expected = brute_components({simhash.signed(f) for f in fps}, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for cell in (2, 64):
        monkeypatch.setattr(simhash, "CELL", cell)
        ws = Workspace(spark, "t")
        df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
        got = {r.node: r.component for r in connected_components(simhash.links(df, ws), ws).collect()}
        assert {n: got.get(n, n) for n in expected} == expected


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}


def test_keep_one(spark):
    rows = corpus(120, 4)
    rows += [(None, rows[3][1]), (5, rows[7][1]), (5, rows[7][1]), (500, None), (501, ""), (1, rows[1][1]), (1, rows[1][1]), (None, "only here, once and again")] + [(600, "a b c d e")] * 3
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    classes = {}
    comp = brute_components({brute_fingerprint(t) for _, t in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    for d, t in rows:
        c = comp[brute_fingerprint(t)]
        classes[c] = min(classes.get(c, 1 << 63), (1 << 63) - 1 if d is None else d)
    kept = got.collect()
    assert sorted((comp[brute_fingerprint(r.text)], r.doc_id if r.doc_id is not None else (1 << 63) - 1) for r in kept) == sorted(classes.items())
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_copies_of_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rows = [(i, "one hot text of several words" if i % 2 else f"text {i} " + "x y z " * i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    comp = brute_components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i in sorted(fps):
        first.setdefault(comp[fps[i]], i)
    assert len(got) == 40 and all(got[i].component_id == first[comp[fps[i]]] for i in fps)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(first.values())
