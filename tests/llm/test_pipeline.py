from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from llm.test_decontaminate import by_hand as contaminated_by_hand  # noqa: E402
from llm.test_line_dedup import by_hand as lines_by_hand  # noqa: E402
from llm.test_packing import check  # noqa: E402
from llm.test_simhash import by_hand as fingerprint_by_hand  # noqa: E402
from llm.test_simhash import groups  # noqa: E402

from keepline.llm import quality  # noqa: E402
from keepline.llm.common import read  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage, and the last result."""
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
    return [*out, docs]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality(spark, stages):
    judged = quality.quality_rules(stages[0], read(spark, SF, "labels")).where("kept")
    assert {r.doc_id for r in judged.collect()} == set(texts(stages[1]))
    assert 0 < len(texts(stages[1])) < len(texts(stages[0]))


def test_lines(stages):
    before, after = texts(stages[1]), stages[2].collect()
    want = {i: kept for i, (_, _, kept) in lines_by_hand(sorted(before.items())).items()}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(stages):
    before = texts(stages[2])
    root = groups({i: fingerprint_by_hand(t) for i, t in before.items()}, 4)
    assert texts(stages[3]) == {i: t for i, t in before.items() if root[i] == i}


def test_decontamination(spark, stages):
    before = texts(stages[3])
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    judged = contaminated_by_hand(sorted(before.items()), items[:3])
    after = texts(stages[4])
    assert after == {i: before[i] for i in after}
    assert not {i for i, x in judged.items() if x[3]} & set(after)


def test_packing(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[4].collect()]
    check(stages[5].collect(), rows, 2048)


def test_run_is_the_same(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows(spark, odd_docs):
    """Null ids and texts, repeated rows and clashing names go through every stage."""
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, docs, SF))
        assert after.dtypes == odd_docs.dtypes
        docs = after
    left = {(r.doc_id, r.text) for r in docs.collect()}
    assert {i for i, _ in left} <= {None, 1, 2, 5}
    assert {i for i, t in left if not t} == {2}  # its only line stays in document 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()
