import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def same(df, con, sql, tmp_path):
    """Rows only on one side, either way."""
    df.write.parquet(str(tmp_path / "out"))
    con.execute(f"CREATE OR REPLACE TEMP TABLE want AS {sql}")
    con.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = {t: [r[0] for r in con.execute(f"DESCRIBE {t}").fetchall()] for t in ("want", "got")}
    assert sorted(columns["want"]) == sorted(columns["got"])
    names = ", ".join(f'"{c}"' for c in sorted(columns["want"]))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT * FROM (SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}) LIMIT 3").fetchall() == []
    return con.execute("SELECT count(*) FROM want").fetchall()[0][0]
