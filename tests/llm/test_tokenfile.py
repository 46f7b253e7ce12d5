import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillframe.llm import tokenfile
from quillframe.llm.encode import Encoder, TokenCounter
from quillframe.llm.mph import MinimalPerfectHash, key_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
CACHED = Encoder(PATH, cache_bytes=10_000)
COUNTED = TokenCounter(PATH, cache_bytes=10_000)
TEXTS = [
    "", " ", "  a  b ", "the cat's mat. It's\n\nover ,there...\t x", "\n a\nb \n", "Ärger über çà, ñ! déjà-vu", "a.\nB,\nc!! d### $$$x 12 3a4 x's 's", "<|endoftext|> a<|endoftext|>b <|endoftext|>",
    "日本語 テキスト です　x y", "x\x1cy \x1c z\x85 w", "word," * 30, "naïvé é́ ʼs ’s", "a\r\nb \r c", "it'll we've I'd 'tis\n'twas",
]


def ids(raw):
    return np.frombuffer(raw, CACHED.dtype).tolist()


def test_encoder_equals_library():
    for text, raw in zip(TEXTS, CACHED.encode(TEXTS)):
        assert ids(raw) == PLAIN.encode(text, add_special_tokens=False).ids
    assert COUNTED.encode(TEXTS) == [len(ids(raw)) for raw in CACHED.encode(TEXTS)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab éÀ'st.,!#$1२ \n\t\r\x1c\x85　|’*"), max_size=40) | st.text(max_size=30))
def test_encoder_equals_library_on_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    want = PLAIN.encode(text, add_special_tokens=False).ids
    assert ids(CACHED.encode([text])[0]) == want
    assert COUNTED.encode([text]) == [len(want)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["été", "ß", "×", "÷", "«", "'ll", "l'", "’s", "x9", "24", ".,", "#$", "<|", "<|endoftext|>", "日本", "\x00", "\x85", "\t", "\n", " ", " ", " "]), max_size=12), max_size=6))
def test_encoder_cuts_inside_words_as_the_library(parts):
    texts = ["".join(p) for p in parts]
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids(raw) for raw in CACHED.encode(texts)] == want
    assert COUNTED.encode(texts) == [len(w) for w in want]


@pytest.mark.parametrize("kind", [Encoder, TokenCounter])
def test_equal_pieces_are_looked_up_and_remembered_once(kind):
    class Asked(dict):
        n = 0

        def get(self, *args):
            self.n += 1
            return super().get(*args)

    enc = kind(PATH)
    enc.new = Asked()
    text = " ".join(f"{word}{marks}" for word in ("alpha", "beta", "gamma") for marks in ("", ".", ",", "!?", "###", "42") for _ in range(50))
    assert enc.encode([text] * 20) == kind(PATH, cache_bytes=1).encode([text] * 20)
    # the words with and without a space before, five kinds of marks and numbers, line ends; 18,000 words in all
    assert len(enc.new) <= 12 and enc.new.n <= 40


def test_texts_of_several_batches_are_encoded_at_once(monkeypatch):
    monkeypatch.setattr(tokenfile, "RUN_CHARS", 100)
    texts = [b"a b" * (i % 40) for i in range(60)]
    batches = [pa.record_batch({"key": [f"{i}" for i in range(at, at + 5)], "text": texts[at : at + 5]}) for at in range(0, 60, 5)]
    calls = []

    class Spy:
        def encode(self, texts):
            calls.append(len(texts))
            return CACHED.encode(texts)

    got = list(tokenfile._encoded(Spy(), batches))
    assert got == list(zip([f"{i}" for i in range(60)], CACHED.encode([t.decode() for t in texts])))
    assert max(calls) > 5 and len(calls) > 3


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_minimal_perfect_hash(n):
    keys = [f"k{i}".encode() for i in range(n)]
    a, b = key_hashes(keys)
    table = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(a, b).to_bytes())
    assert sorted(table.slots(a, b).tolist()) == list(range(n))


SCHEMA = "doc_id long, text string, key string, start string"


def brute(rows, end_id):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, out = 0, []
    for doc_id, text in order:
        x = [*PLAIN.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_store_matches_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BUCKET_KEYS", 40)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Γάμμα", "\n", ""]) for _ in range(rng.randint(0, 30)))) for i in rng.sample(range(-500, 500), 300)]
    rows += [(1000, None), (1001, ""), (1002, "long " * 50000)]
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in rows], SCHEMA)
    path = f"file://{tmp_path}/store"
    tokenfile.write_store(df, path, PATH, end_id=2)
    got = tokenfile.stored_documents(spark, path).collect()
    assert all(r.indexed for r in got)
    assert sorted((int(r.key), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(brute(rows, 2))
    asked = spark.createDataFrame([("1001",), ("1000",), ("absent",), (None,), ("1001",)], "key string")
    assert sorted((r.key, r.ids) for r in tokenfile.read_ids(spark, path, asked).collect()) == [("1000", [2]), ("1001", [2])]
    texts = dict(rows)
    some = [i for i, _ in rows[:50]]
    back = tokenfile.read_ids(spark, path, spark.createDataFrame([(str(i),) for i in some], "key string")).collect()
    assert {int(r.key): r.ids for r in back} == {i: [*PLAIN.encode(texts[i], add_special_tokens=False).ids, 2] for i in some}


def test_copies_and_null_keys(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b c"), (None, "x"), (None, None), (2, "z")]
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in rows], SCHEMA)
    path = f"file://{tmp_path}/store"
    tokenfile.write_store(df, path, PATH, end_id=2)
    got = sorted(tokenfile.stored_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None, None, "1", "1", "1", "2"]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    assert [r.indexed for r in got] == [False, False, True, False, False, True]
    assert sum(r.n_tokens for r in got) == sum(len(PLAIN.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    path = f"file://{tmp_path}/store"
    tokenfile.write_store(df, path, PATH, end_id=2)
    assert tokenfile.stored_documents(spark, path).count() == 0


def bytes_read(spark, action):
    """The rows of a DataFrame, and the bytes of files that its jobs read."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    before = total()
    rows = action()
    return rows, total() - before


def test_a_key_is_found_without_reading_the_rest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BUCKET_KEYS", 25)
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 20_000)
    monkeypatch.setattr(tokenfile, "FOLDERS", 20)
    rng = random.Random(3)
    texts = {i: " ".join(f"{rng.randrange(10**9)}" for _ in range(700)) for i in range(1000)}
    path = f"file://{tmp_path}/store"
    tokenfile.write_store(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, PATH, end_id=2)
    size = {name: sum(f.stat().st_size for f in (tmp_path / "store" / name).rglob("*.parquet")) for name in ("payload", "index")}
    files = {name: len(list((tmp_path / "store" / name).rglob("*.parquet"))) for name in ("payload", "index")}
    assert files["index"] == 20 and files["payload"] >= 4 and size["payload"] > 4_000_000
    meta = spark.read.parquet(f"{path}/meta").first()
    assert (meta.buckets, meta.folders) == (40, 20)
    one = spark.createDataFrame([("517",)], "key string")
    rows, n = bytes_read(spark, lambda: tokenfile.read_ids(spark, path, one).collect())
    assert rows[0].ids == [*PLAIN.encode(texts[517], add_special_tokens=False).ids, 2]
    # a hundred blocks or so: one of them, one bucket, and footers are a small part of the whole
    assert 0 < n < (size["payload"] + size["index"]) / 10, (n, size)
    monkeypatch.setattr(tokenfile, "FEW", 0)
    again, m = bytes_read(spark, lambda: tokenfile.read_ids(spark, path, one).collect())
    assert again == rows and m > n
