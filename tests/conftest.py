"""One session for all tests; DuckDB over the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from heddle.session import session

    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = session("tests", **{k.replace(".", "__"): v for k, v in conf.items()})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Compare a Spark frame with DuckDB's rows, whatever their order."""

    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        if isinstance(v, list):
            return tuple(map(value, v))
        return v

    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        mine = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=str)
        at = [relation.columns.index(c) for c in names]
        theirs = sorted((tuple(value(r[i]) for i in at) for r in relation.fetchall()), key=str)
        assert mine == theirs

    return check
