import duckdb
import pytest
from pyspark.sql import Window

from cairn.queries import ORACLES, QUERIES
from cairn.queries_rows import ORACLES as ROWS_SQL
from cairn.queries_rows import QUERIES as ROWS
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ROWS))
def test_python_query_equals_sql(spark, sf_dir, con, name):
    compare(spark, con, sf_dir, ROWS[name], ROWS_SQL[name])


def test_hash_backfill_whole(spark, sf_dir):
    from pyspark.sql import functions as F

    from cairn.adapters import document_files
    from cairn.operators.scan import hash_backfill
    from cairn.queries import HASH_BYTES

    assert QUERIES["hash_backfill_whole"](spark, sf_dir).where("content_hash is null or magic_bytes is null").count() == 0
    f = document_files(spark, sf_dir, body=True).orderBy("file_id").limit(2).withColumn("size", HASH_BYTES + F.row_number().over(Window.orderBy("file_id")) - 1)
    assert [r.content_hash is None for r in hash_backfill(f, HASH_BYTES).orderBy("file_id").collect()] == [False, True]


def test_sniffing_reads_the_sample(spark, tmp_path):
    spark.createDataFrame([(5, "a\0b"), (1, "a" * 30 + "\0"), (11, "plain")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.file_id: r.is_text for r in QUERIES["sniff_text"](spark, str(tmp_path)).collect()}[5] is False
    assert {r.file_id: r.format for r in QUERIES["format_magic"](spark, str(tmp_path)).collect()} == {1: "binary", 5: "binary", 11: "text"}


def test_markers_recorded_after_now_follow_the_sql(spark, tmp_path):
    rows = [(k, 7 * k) for k in (39_997, 39_999, 40_000, 40_001, 40_003, 40_005, 149_999)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    compare(spark, con, str(tmp_path), QUERIES["marker_lifetime"], ORACLES["marker_lifetime"])


def test_a_marker_recorded_after_now_has_no_rate(spark):
    from cairn.operators.fresh import marker_lifetime

    row = spark.createDataFrame([(0, 9 * 10**9, 50, 0, 1000, 10**9)], "next_usn long, recorded_ns long, live_next_usn long, first_usn long, maximum_size long, now_ns long")
    got = marker_lifetime(row).first()
    assert (got.age_s, got.rate, got.remaining_s) == (0.0, 0.0, None)


def test_format_magic_equals_sql_on_odd_texts(spark, tmp_path):
    texts = ["", None, "RIFF is no wave", "RIFFxxxxAVI list", "RIFFxxxxWEBPVP8", "....ftypmif1", "....ftypheic", "﻿<?xml version", "\x01\x02\x03\x04\x05\x06\x07 controls", "%!PS", "BM", "é" * 300, "x" + "é" * 300, "xx" + "語" * 300]
    rows = [(2 * i + k, t) for i, t in enumerate(texts) for k in (1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    compare(spark, con, str(tmp_path), QUERIES["format_magic"], ORACLES["format_magic"])
