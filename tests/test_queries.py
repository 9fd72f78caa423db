"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from framelake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(v, 5) if isinstance(v, float) else None if v is None else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(plain(r) for r in df.select(*columns).collect())
    want = Counter(plain(r) for r in duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({ORACLE[name]})").fetchall())
    assert got == want
    assert got, "no rows to compare"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_every_turn_is_on_screen(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("conv_id", "turn", "trim(regexp_replace(text, '[\n\r]', ' ')) AS text").filter("text <> ''").select("conv_id", "turn").distinct()
    assert turns.filter("turn > 5").count() > 0
    assert QUERIES["subtitle_interval_join_whole"](spark, SF).select("conv_id", "turn").distinct().exceptAll(turns).count() == 0
    assert turns.exceptAll(QUERIES["subtitle_interval_join_whole"](spark, SF).select("conv_id", "turn").distinct()).count() == 0


def test_every_frame_has_a_histogram(spark):
    frames = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").distinct()
    assert QUERIES["histogram_256"](spark, SF).count() == frames.count() * 4 * 256


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
