"""Columns of any name and type beside the operators' own."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.llm import decontam, html, langid, packing, passages, quality, rules, simhash, urls

NAMES = (
    "_id _text _doc _cut _text_key _spans _passages _lid _rejected _contamination _key _key_a _key_b _base _found _ids m items spans shard n_tokens cluster"
    " _alias _host _path _page _rule host path rule verdict fp root component node key part band c x lo hi n u v w b doc_ids"
).split()
RULES = [("net", "/", "block")]


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    shared = say(rng, 60)
    rows = [(i, say(rng, 40) + "\n" + (shared if i % 3 == 0 else say(rng, 60)), "en", "s") for i in range(20)] + [(None, None, None, None), (30, "", "en", "s"), (3, "x", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tags = F.create_map(F.lit("k"), F.col("doc_id")).alias("tags")
    return df.select("*", tags, *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in NAMES]).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("q1", "some words that occur nowhere at all in these texts really"), ("q2", "other words")], "item_id string, text string")


def untouched(before, after):
    """The extra columns of the rows that are left are as they were."""
    assert after.columns[: len(before.columns)] == before.columns
    extra = ["tags", *NAMES]
    was = sorted(str(r.asDict()) for r in before.select(*extra).collect())
    left = [str(r.asDict()) for r in after.select(*extra).collect()]
    assert len(left) <= len(was) and set(left) <= set(was)
    return len(left)


STAGES = {
    "language": lambda d, b: langid.keep_identified(d),
    "one": lambda d, b: simhash.keep_one(d),
    "passages": lambda d, b: passages.without_passages(d),
    "clean": lambda d, b: decontam.drop_contaminated(d, b),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(docs, bench, name):
    out = STAGES[name](docs, bench)
    assert out.columns == docs.columns
    assert untouched(docs, out) >= {"language": 19, "one": 21, "passages": 22, "clean": 23}[name]
    empty = STAGES[name](docs.limit(0), bench)
    assert empty.columns == docs.columns and empty.collect() == []


MARKS = {
    "language": lambda d, b: langid.mark_rejected(langid.score(d, langid.train(d)), langid.calibrate(d)),
    "passages": lambda d, b: passages.dedup_passages(d),
    "contamination": lambda d, b: decontam.mark_contaminated(d, b),
    "contamination_by_blocks": lambda d, b: decontam.mark_contaminated(d, b, table_bytes=20),
    "quality": lambda d, b: quality.score(d, quality.train(d)),
    "rules": lambda d, b: rules.judge(d, rules.references(d)),
    "urls": lambda d, b: urls.judge(d.withColumn("url", F.lit("http://a.net/x")).withColumn("html", F.lit("<link rel=canonical href='http://b.org/'>")), RULES).drop("url", "html"),
    "html": lambda d, b: html.extract(d, html_col="text", out="main"),
}


@pytest.mark.parametrize("name", MARKS)
def test_marks_keep_rows_and_columns(docs, bench, name):
    assert untouched(docs, MARKS[name](docs, bench)) == 23


def test_results_of_their_own(docs):
    assert simhash.near_duplicates(docs).count() == 23
    from quillframe.llm.queries import tokenizer_path

    assert packing.pack_documents(docs, tokenizer_path()).count() == 23
