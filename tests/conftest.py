import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"{base}/checkpoints", "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(df) -> list[tuple]:
    """Rows with columns by name, sorted, floats rounded."""
    names = sorted(df.columns)
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in (r[n] for n in names)) for r in df.collect()), key=repr)


def against_sql(spark, query, sql, folder=DATA):
    import duckdb

    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = query(spark, folder)
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    want = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in (float(r[n]) if type(r[n]).__name__ == "Decimal" else r[n] for n in sorted(names))) for r in want), key=repr)
    assert rows_of(got) == want
