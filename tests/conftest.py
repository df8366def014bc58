import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from utterlake.session import build_session

    s = build_session(cpus=4, shuffle_partitions=4, app="tests", memory="4g")
    s.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """compare(query, sql, root): both give the same columns and the same rows."""
    import duckdb

    from utterlake.catalog import TABLES

    def value(v):
        if isinstance(v, float):
            return round(v, 9)
        return float(v) if hasattr(v, "as_tuple") else v

    def run(query, sql, root):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
        df = query(spark, root)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        assert cols == sorted(rel.columns)
        ours = sorted((tuple(map(value, r)) for r in df.select(*cols).collect()), key=str)
        theirs = sorted((tuple(map(value, r)) for r in con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql})").fetchall()), key=str)
        assert len(ours) == len(theirs)
        assert ours == theirs

    return run
