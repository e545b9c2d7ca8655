import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reportloom.session import local_session  # noqa: E402

# Started on import: column expressions at module level need an active session.
SESSION = local_session("4", 4)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of an expression on one row of named string columns."""

    def run(expression, **columns):
        schema = ", ".join(f"{name} string" for name in columns) or "x string"
        row = tuple(columns.values()) or ("",)
        return spark.createDataFrame([row], schema).select(expression.alias("r")).first()["r"]

    return run
