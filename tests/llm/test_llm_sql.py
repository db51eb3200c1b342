import pytest

import oracle_compare as oc
from revlens.llm import queries

SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = oc.duck_connection(SF001)
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = oc.frame_digest(con.execute(queries.oracle_sql()[name]).df())
    got = oc.frame_digest(queries.queries()[name](spark, SF001).toPandas())
    assert got[:3] == want[:3]
