import tempfile

import pytest

from quillspark.session import drop_tables, get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                               "spark.driver.memory": "4g", "spark.default.parallelism": "4",
                               "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quillspark-tests-")}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_tables(session)
    session.stop()
