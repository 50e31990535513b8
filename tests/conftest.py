import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelwright.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 2)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows of (timestamp text, ...) under a schema that starts with the timestamp."""
    def build(rows, columns):
        from pyspark.sql import functions as F
        types = {"timestamp": "string", "asset": "string", "source": "string", "source_asset": "string"}
        schema = ", ".join(f"{c} {types.get(c, 'double')}" for c in columns)
        clean = [tuple(v if isinstance(v, str) or v is None else float(v) for v in r) for r in rows]
        return spark.createDataFrame(clean, schema).withColumn("timestamp", F.to_timestamp("timestamp"))
    return build
