"""Every registered corpus query that SQL can express against its SQL."""

import pytest

from pulsegrid.llm.queries import ORACLES, QUERIES
from tests.oracle import agrees, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert agrees(spark, con, SF, QUERIES[name], ORACLES[name]) == 200


@pytest.mark.parametrize("name", ["op2_simhash", "op4_fingerprint", "op7_quality", "op10_language_id"])
def test_one_row_for_each_document(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() == 200 and df.select("doc_id").distinct().count() == 200


def test_one_row_for_each_page(spark):
    assert QUERIES["op1_html_text"](spark, SF).count() == 50
