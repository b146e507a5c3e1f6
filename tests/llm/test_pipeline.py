"""The pipeline's stages, each over what the one before kept, and its registered queries against SQL."""

import sys
from pathlib import Path

import corpus_pipeline
import pytest

from loomtable.llm.queries import ORACLES, QUERIES, table
from loomtable.llm.shared import materialize

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, connect  # noqa: E402

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


def test_stages_keep_clean_documents_and_decide(spark):
    # At the smallest size too few labelled rows are toxic to learn from.
    docs = table(spark, LARGER, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, LARGER), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] == sizes[2]
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3] > sizes[4] > sizes[0] // 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
