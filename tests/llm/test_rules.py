import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.llm import rules

SCHEMA = "doc_id long, text string, lang string, n_words string, rules string, kept string"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é#*|\n\t\r\x0b\x0c\x1c\x85 　<"), max_size=80))
def test_base_counts(text):
    assert rules.base_counts(text.encode()) == brute_counts(text)


def brute_distance(p, q):
    sp, sq = sum(p.values()), sum(q.values())
    if not sp or not sq:
        return 0.0
    total = 0
    for k in p.keys() | q.keys():
        a, b = p.get(k, 0) / sp, q.get(k, 0) / sq
        m = (a + b) / 2
        total += (a and a * math.log2(a / m)) + (b and b * math.log2(b / m))
    return math.sqrt(max(0, total / 2))


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    chars, words = {}, {}
    for _, text, lang in rows:
        if lang is not None:
            chars.setdefault(lang, Counter()).update(rules._class_of(c) for c in text or "")
            words.setdefault(lang, Counter()).update(words_of(text))
    common = {x: {w for w, n in c.items() if n >= sum(c.values()) * rules.COMMON} for x, c in words.items()}
    fold = lambda c, x: Counter({w: n for w, n in c.items() if w in common[x]}) + Counter({"": sum(n for w, n in c.items() if w not in common[x])})
    out = []
    for doc_id, text, lang in rows:
        counts = brute_counts(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        own = words_of(text)
        options = []
        for x in [lang] if lang in chars else sorted(chars):
            c = brute_distance(Counter(map(rules._class_of, text or "")), chars[x]) if len(text or "") >= rules.LEAST_CHARS_COMPARED else 0
            w = brute_distance(fold(Counter(own), x), fold(words[x], x)) if len(own) >= rules.LEAST_WORDS_COMPARED else 0
            options.append((c, w))
        c, w = min(options, key=sum) if options else (0, 0)
        out.append((doc_id, *counts, failed, not failed and c <= rules.CHAR_DISTANCE and w <= rules.WORD_DISTANCE, round(c, 6), round(w, 6)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    vocab = {"xx": "the of and there Thing that".split() + [f"rare{i}" for i in range(900)], "yy": "der und die schön nicht Öl".split()}
    rows = []
    for i in range(80):
        lang = rng.choice(["xx", "yy"])
        n = rng.choice([3, 45, 60, 200, 400])
        text = " ".join(rng.choice(vocab[lang][:6] if rng.random() < 0.6 else vocab[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))
        if i % 9 == 0:
            text = text.upper().replace(" ", " ### ")
        if i % 7 == 0:
            text += "\nsame line\nsame line\n \n \nsame line"
        rows.append((i, text, rng.choice([lang, lang, None, "zz" if i == 3 else lang])))
    return rows + [(100, None, "xx"), (101, "", None), (None, rows[4][1], "xx"), (4, *rows[4][1:]), (4, *rows[4][1:]), (102, "word " * 30000, "yy")]


def result(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = rules.report(df).collect()
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.char_distance, 6), round(r.word_distance, 6)) for r in got), key=str)


def test_report_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    assert result(spark, rows) == brute(rows)
    assert {r[7] for r in brute(rows)} == {True, False}


def test_without_references_and_empty(spark):
    rows = [(i, t, None) for i, t, _ in corpus()]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
