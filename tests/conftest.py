import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from factloom.plans.session import local_session

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture()
def files(spark):
    def make(*pairs):
        return spark.createDataFrame(list(pairs), "path string, content string")

    return make


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=repr)
