import pytest
from oracle import DATA, compare, connect

from corvane.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    compare(spark, connect(), QUERIES[name], SQL[name])


COLUMNS = {"p1_found": ["id"], "p2_found": ["id", "field_name"], "p3_found": ["id", "defect"], "p4_found": ["session_id", "reason"], "p5_found": ["chunk_id"], "p7_found": ["chunk_id_a", "chunk_id_b"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns_and_distinct_rows(spark, name):
    d = QUERIES[name](spark, str(DATA))
    assert d.columns == COLUMNS[name]
    rows = d.collect()
    assert len(rows) == len(set(rows))
