"""Every operator on odd, empty and clashing input."""

import pytest

from tesserae.llm import context_coder, decontaminate, license_scan, near_dedup, pii_crf, quality_rules, secret_scan, simhash, source_mix, substring_dedup, suffix_tree_lm, token_output
from tesserae.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "tie a b c"), (2, None), (None, ""), (3, "absent words of a long enough item here")], "item_id long, text string")


def ops(labels, bench):
    return {
        "license": (lambda d: license_scan.scan_licenses(d, ["doc_id"]), None),
        "quality": (lambda d: quality_rules.quality_report(d, labels), 12),
        "secret": (secret_scan.secret_report, 12),
        "simhash": (simhash.near_duplicate_report, 12),
        "lm": (suffix_tree_lm.score, 12),
        "decontaminate": (lambda d: decontaminate.contaminated(d, bench, ["doc_id"]), 2),
        "tokens": (lambda d: token_output.token_report(d, tokenizer_path()), 12),
        "mix": (source_mix.mix_report, 12),
        "substring": (substring_dedup.dedup_passages, 12),
        "pii": (pii_crf.find_pii, 12),
        "keep_good": (lambda d: quality_rules.keep_good(d, labels), 1),
        "near": (near_dedup.drop_near_duplicates, 7),
        "clean": (lambda d: decontaminate.clean_documents(d, bench), 10),
        "mix_documents": (source_mix.mix_documents, None),
    }


NAMES = ["license", "quality", "secret", "simhash", "lm", "decontaminate", "tokens", "mix", "substring", "pii", "keep_good", "near", "clean", "mix_documents"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(odd, labels, bench, name):
    f, n = ops(labels, bench)[name]
    got = f(odd)
    rows = got.collect()
    if n is not None:
        assert len(rows) == n
    if name in ("keep_good", "near", "clean", "mix_documents"):
        assert got.columns == odd.columns
    else:
        assert {r["doc_id"] for r in rows} <= {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(empty, labels, bench, name):
    assert ops(labels, bench)[name][0](empty).collect() == []


def test_ties_and_repeats(odd):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicate_report(odd).collect()}
    assert got[(3, "0" * 16)] == got[(2, "0" * 16)] == 1
    assert {v for (i, _), v in got.items() if i in (4, 5)} == {4}
    kept = [r["doc_id"] for r in near_dedup.drop_near_duplicates(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 6, 7, 8, 9, None], key=str)


def test_damaged_blocks_are_found():
    import numpy as np

    ids = np.arange(9000) % 700
    data = bytearray(context_coder.encode(ids, 50_257))
    assert (context_coder.decode(bytes(data)) == ids).all()
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        context_coder.decode(bytes(data))


def test_stages_of_the_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    left = {"quality_rules": None, "near_dedup": 7, "decontaminate": 12, "source_mix": None, "token_output": 12}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        rows = got.collect()
        assert left[name] is None or len(rows) == left[name]
        assert {r["doc_id"] for r in rows} <= {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
        if name != "token_output":
            assert got.columns == odd.columns
        if name == "quality_rules":
            assert not {1, 2, 3} & {r["doc_id"] for r in rows}
        assert stage(spark, empty, sf).collect() == []
