"""Every registered query against its SQL, as whole sorted row sets."""

import os

import duckdb
import pytest

from stowage.plans import more, oracle, registry

DATA = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql() | more.oracle_sql()
QUERIES = registry.queries() | more.queries()


def norm(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in frame.collect())
    expected = db.sql(SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_can_read_judges_every_whole_document(spark, tmp_path):
    trailer = lambda magic: "a" * 500_000 + magic + "b" * (512 - len(magic))
    image = "c" * 32768
    texts = [None, "", "koly", trailer("koly"), trailer("conectix"), image + "\x01CD001" + "d" * 3000, "e" * 360 * 1024, "f" * (64 * 1024), "g" * (64 * 1024 - 1)]
    expected = [set(), set(), set(), {"dmg", "raw"}, {"vhd", "raw"}, {"iso"}, {"img", "raw"}, {"raw"}, set()]
    spark.createDataFrame([(k, t, "en", "src0") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["can_read"](spark, str(tmp_path)).collect()
    assert {r["pos"]: {k for k in ("dmg", "iso", "vhd", "img", "raw") if r[k]} for r in rows} == dict(enumerate(expected))


def test_validate_write_tells_bytes_from_characters(spark, tmp_path):
    texts = [None, "é" * 49, "é" * 50, "é" * 99, "é" * 100, "a" * 99, "a" * 100, "ü" * 60, "b" * 99]
    spark.createDataFrame([(k, t, "en", "src0") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.queries()["validate_write"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(SQL["validate_write"]).fetchall())
    assert [r[1] for r in got][1:4] == [False, True, True]
