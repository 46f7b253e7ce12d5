import random
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillframe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, source string, bin_id string, piece string"


def check(rows, placed, capacity):
    """Every token once, no bin over its capacity, no conflict in a bin."""
    by_id = {i: (n, s, c) for i, n, s, c in rows}
    covered, bins = defaultdict(list), defaultdict(list)
    for doc_id, piece, start, n, b, offset in placed:
        covered[doc_id].append((start, n))
        bins[b].append((offset, n, doc_id))
        assert start == piece * capacity
    assert set(covered) == {i for i, n, _, _ in rows if n}
    for doc_id, parts in covered.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and 0 < n <= capacity
            at += n
        assert at == by_id[doc_id][0]
    for parts in bins.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        for k in (1, 2):
            names = Counter(by_id[i][k] for _, _, i in parts)
            assert all(n == 1 for x, n in names.items() if x is not None)


def brute(rows, capacity):
    """Best fit by looking at all bins."""
    order = sorted(rows, key=lambda r: (-(r[1] % capacity), r[0], r[1], str(r[3]), str(r[2])))
    bins, where = [], {}
    for doc_id, n, source, cluster in order:
        size = n % capacity
        if not size:
            continue
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and source not in b["s"] and cluster not in b["c"]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"room": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        b = bins[i]
        where[doc_id] = (i, capacity - b["room"])
        b["room"] -= size
        b["s"] |= {source} - {None}
        b["c"] |= {cluster} - {None}
    return where


row = st.tuples(st.integers(1, 70), st.sampled_from([None, "a", "b", "c", "d"]), st.sampled_from([None, 1, 2, 3, 4, 5, 6]))


@settings(max_examples=200, deadline=None)
@given(st.lists(row, max_size=60))
def test_pack_is_best_fit(found):
    rows = [(i, n, s, c) for i, (n, s, c) in enumerate(found)]
    placed = packing.pack(rows, 20)
    check(rows, placed, 20)
    assert {r[0]: (r[4], r[5]) for r in placed if r[3] < 20} == brute(rows, 20)


def documents():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(["alpha", "beta,", "Γ"]) for _ in range(rng.choice([2, 30, 200, 900])))
        rows.append((i, rows[-1][1].upper() if i % 10 == 1 else text, rng.choice(["hot", "hot", "b", "c", "d", None])))
    return rows + [(400, None, "b"), (401, "", None), (402, "long " * 30000, "hot")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "p") for r in rows], SCHEMA)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 100)
    rows = documents()
    got = [tuple(r) for r in packing.pack_documents(frame(spark, rows), PATH, capacity=512).collect()]
    sized = [(i, len(PLAIN.encode(t or "", add_special_tokens=False).ids) + 1, s, " ".join((t or "").lower().split()) or None) for i, t, s in rows]
    check(sized, got, 512)
    assert len({b >> 32 for *_, b, _ in got}) == 4


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same text", "a")] * 5 + [(None, "same text", None)] * 3
    got = packing.pack_documents(frame(spark, rows), PATH).collect()
    assert Counter(r.doc_id for r in got) == {1: 5, None: 3}
    assert len({r.bin_id for r in got}) == 8
    assert packing.pack_documents(frame(spark, rows[:0]), PATH).collect() == []
