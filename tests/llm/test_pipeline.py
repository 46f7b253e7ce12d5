import os
import re

import pytest

import corpus_pipeline
from quillframe.llm import decontam, langid, packing, passages, simhash
from quillframe.llm.common import table
from tests.llm.test_decontam import brute as brute_contaminated
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages_one_by_one(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain reading of its task."""
    docs = table(spark, SF, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontaminated", "packed"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packed":
            assert after.columns == docs.columns
            kept = {r.doc_id: r for r in after.collect()}
            assert len(kept) == after.count() and set(kept) <= set(before)
        if name == "language":
            assert len(kept) >= 0.99 * len(before)
            assert all(any(c.isalpha() for c in r.text) for r in kept.values())
        elif name == "near_duplicates":
            fps = {d: brute_fingerprint(r.text) for d, r in before.items()}
            comp = brute_components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
            first = {}
            for d in sorted(before):
                first.setdefault(comp[fps[d]], d)
            assert set(kept) == set(first.values())
        elif name == "repeated_passages":
            assert set(before) - set(kept) <= {d for d, r in before.items() if len(r.text.split()) >= passages.RUN}
            for d, r in kept.items():
                assert set(r.text.split()) <= set(before[d].text.split())
                if r.text != before[d].text:
                    assert len(before[d].text.split()) - len(r.text.split()) >= passages.RUN
        elif name == "decontaminated":
            hit = {r[0] for r in brute_contaminated([(d, r.text) for d, r in before.items()], bench) if r[5]}
            assert set(kept) == set(before) - hit
        else:
            from tests.llm.test_packing import PLAIN

            rows = [(d, len(PLAIN.encode(r.text, add_special_tokens=False).ids) + 1, r.source, re.sub(r"\s+", " ", r.text.lower()).strip()) for d, r in before.items()]
            check_packing(rows, [tuple(r) for r in after.collect()], packing.CAPACITY)
        docs = after


def test_run_equals_stages(spark):
    ran = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    want = packing.pack_documents(decontam.drop_contaminated(passages.without_passages(simhash.keep_one(langid.keep_identified(docs))), table(spark, SF, "benchmark")), corpus_pipeline.tokenizer_path())
    assert {(r.doc_id, r.piece, r.n_tokens) for r in ran.collect()} == {(r.doc_id, r.piece, r.n_tokens) for r in want.collect()}
