import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vulnsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
        spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """Builds a file table from (path, content) pairs."""
    def build(*pairs):
        rows = [(i, path, content) for i, (path, content) in enumerate(pairs)]
        return spark.createDataFrame(rows, "file_id long, path string, content string")
    return build
