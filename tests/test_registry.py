"""The driver contract."""

import __spark_entry__ as contract


def test_every_sql_belongs_to_a_query_and_the_entry_runs(spark):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert len(queries) > 120 and set(sql) <= set(queries)
    out = contract.entry(spark)
    assert out.columns == ["bar", "price_pnl", "funding_pnl", "cost", "ret", "turnover", "equity", "drawdown"]
    assert out.count() > 300


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as c; assert len(c.queries()) >= len(c.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=Path(contract.__file__).parent, check=True, capture_output=True)
