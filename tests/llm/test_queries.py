import os

import pytest

from pricewise.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    from tests.oracle_check import compare, duck
    res = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
    assert res["status"] == "OK", res


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_groups_of_the_smallest_table_agree_with_brute_force(spark):
    from .helpers import groups
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_near_dedup"](spark, SF).collect()}
    assert got == groups(rows)


def test_registry():
    import corpus_pipeline
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, len(QUERIES) + 1)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "dedup", "mix", "encode"]
