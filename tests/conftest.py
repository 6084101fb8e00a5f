import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brindle.session import get_session

    session = get_session("tests", cpus=int(os.environ.get("TEST_CPUS", "4")), memory="3g", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """compare(frame, sql, folder): whether Spark's rows and DuckDB's are the same, whatever their order."""
    duckdb = pytest.importorskip("duckdb")

    def run(frame, sql, folder=SMALL):
        connection = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        want, got = connection.execute(sql).df(), frame.toPandas()
        assert sorted(want.columns) == sorted(got.columns)
        names = sorted(want.columns)
        text = lambda df: df[names].astype(str).sort_values(names).reset_index(drop=True)
        left, right = text(got), text(want)
        assert len(left) == len(right)
        assert left.equals(right), left.compare(right).head()

    return run
