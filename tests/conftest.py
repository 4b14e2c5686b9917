import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from curbside.session import build_session

    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def plans(monkeypatch):
    """Physical plans of everything the operators stage."""
    from curbside import session
    from curbside.operators import neighbours, radius, spread, state

    seen = []

    def recording(df, label):
        seen.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return session.stage(df, label)

    for module in (neighbours, radius, spread, state):
        monkeypatch.setattr(module, "stage", recording)
    return seen
