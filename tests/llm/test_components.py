from crawlens.llm.components import _mark


def test_mark_of_many_edges(spark):
    n, total = _mark(spark.range(20_000_000).selectExpr("id AS a", "id + 1 AS b"))
    assert n == 20_000_000 and total > 2**63
