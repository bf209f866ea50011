import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillgate.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("quillgate-tests", cpus=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def ask(spark):
    """Evaluate ``{name: expression}`` over a list of texts in one job."""

    def run(texts, stage=None, **columns):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
        for name, column in (stage or {}).items():
            df = df.withColumn(name, column)
        out = df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
        return [r.asDict(recursive=True) for r in out]

    return run
