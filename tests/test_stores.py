"""Tables on disk, the request sink and database scans."""

from __future__ import annotations

import glob
import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.sources import files, sink, store, tables

PAGES = "url string, module string, title string"


def stamps(path):
    return {f: (os.stat(f).st_mtime_ns, os.stat(f).st_ino) for f in glob.glob(f"{path}/module=*/*.parquet")}


def untouched(before, after, modules):
    part = lambda x: {f: v for f, v in x.items() if not any(f"/module={m}/" in f for m in modules)}
    return part(before) == part(after)


@pytest.fixture()
def saved(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", ["a", "b", "c d", "e=f", None][i % 5], f"t{i}") for i in range(50)], PAGES)
    path = str(tmp_path / "pages")
    tables.save(rows, path)
    return path, rows


def content(df):
    return sorted(map(tuple, df.select("url", "module", "title").collect()), key=str)


def test_reingest_rewrites_its_modules_only(spark, saved):
    path, rows = saved
    before = stamps(path)
    new = spark.createDataFrame([("n1", "c d", "x"), ("n2", "c d", "y")], PAGES)
    for _ in range(2):
        tables.replace_modules(spark, path, new, ["c d", "e=f"])
        want = store.replace_module(store.replace_module(rows, new, "c d"), new.filter("false"), "e=f")
        assert content(tables.read(spark, path, PAGES)) == content(want)
        assert untouched(before, stamps(path), ["c%20d", "c d", "e%3Df"])
    with pytest.raises(ValueError):
        tables.replace_modules(spark, path, new, ["a"])


def test_upsert_rewrites_touched_modules_only(spark, saved):
    path, rows = saved
    before = stamps(path)
    new = spark.createDataFrame([("u0", "a", "changed"), ("u5", "g", "moved to a new module"), ("u999", "a", "new")], PAGES)
    for _ in range(2):
        tables.upsert(spark, path, new, "url")
        assert content(tables.read(spark, path, PAGES)) == content(store.upsert(rows, new, "url"))
        assert untouched(before, stamps(path), ["a", "g"])
    gone = spark.createDataFrame([("u5", "b", "back")], PAGES)
    tables.upsert(spark, path, gone, "url")  # g loses its last row
    assert "g" not in {r.module for r in tables.read(spark, path, PAGES).select("module").distinct().collect()}
    assert store.page_counts(tables.read(spark, path, PAGES)).filter("module = 'b'").first().page_count == 11


def sent(path):
    return [r for f in glob.glob(f"{path}/*.json") for r in json.load(open(f))]


def test_sink_loses_and_doubles_nothing(spark, tmp_path):
    service = tmp_path / "service"
    service.mkdir()
    parents = spark.range(900).select("id", (F.col("id") == 450).alias("bad"))
    children = spark.range(5000).select("id", (F.col("id") % 900).alias("parent"), F.lit(False).alias("bad")).repartition(7)
    options = {"folder": str(service), "pause": "0.01"}
    for _ in range(2):  # the second run sends under the same keys
        log = sink.upload(spark, {"child": children, "parent": parents}, ["parent", "child"], "id", "sink_senders:folder", "j1", str(tmp_path / "log"), options).collect()
        refused = {(r.job, r.batch): r for r in log if r.batch is not None}
        total = {r.job: r for r in log if r.batch is None}
        lost = {f"j1/{t}/{b}" for t, n in (("parent", 5), ("child", 25)) for b in range(n) if zlib.crc32(f"j1/{t}/{b}".encode()) % 6 == 0}
        assert {f"{j}/{b}" for j, b in refused} == lost | {"j1/parent/2"}
        assert refused["j1/parent", 2].error == "bad record" and refused["j1/parent", 2].tries == 1
        assert all(r.tries == 4 and "never answers" in r.error for k, r in refused.items() if k != ("j1/parent", 2))
        got = sent(service)
        assert len(got) == total["j1/parent"].records + total["j1/child"].records == 5900 - 200 * len(lost | {"j1/parent/2"}) + (100 if "j1/parent/4" in lost else 0)
        assert len({(r["id"], r.get("parent")) for r in got}) == len(got)


def test_sink_goes_on_after_a_task_that_died(spark, tmp_path):
    rows = spark.range(1000).select("id")
    options = {"folder": str(tmp_path), "pause": "0.01"}
    run = lambda: sink.upload(spark, {"t": rows}, ["t"], "id", "sink_senders:broken", "j3", str(tmp_path / "log"), options)
    assert zlib.crc32(b"j3/t/1") % 6 > 2  # a request that is taken at once
    with pytest.raises(Exception, match="the worker dies"):
        run()
    refused = {r.batch for r in run().collect() if r.batch is not None}
    got = [r["id"] for r in sent(tmp_path)]
    assert len(got) == len(set(got)) == 1000 - 200 * len(refused)


def test_sink_of_an_empty_table(spark, tmp_path):
    log = sink.upload(spark, {"t": spark.range(0)}, ["t"], "id", "sink_senders:folder", "none", str(tmp_path / "log"), {"folder": str(tmp_path)}).collect()
    assert [(r.requests, r.records, r.refused) for r in log] == [(0, 0, 0)]


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    """A database with keys far apart and crowded, null keys, and tables that need others."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    for text in ("create table CLAIMS (ID bigint not null primary key, DEPT bigint, N int)", "create table DEPTS (ID bigint not null primary key, UP bigint references DEPTS(ID))", "create table NOTES (ID bigint, CLAIM bigint references CLAIMS(ID))", "create table ALONE (ID bigint)", "alter table CLAIMS add foreign key (DEPT) references DEPTS(ID)"):
        statement.execute(text)
    connection.close()
    rows = {
        "DEPTS": spark.createDataFrame([(1, None), (2, 1)], "ID long, UP long"),
        "CLAIMS": spark.createDataFrame([(i if i < 3000 else 10**12 + 7 * i, 1 + i % 2, i % 10) for i in range(4000)] + [(-5 * 10**11, 1, 3)], "ID long, DEPT long, N int"),
        "NOTES": spark.createDataFrame([(None if i % 9 == 0 else i % 50, i) for i in range(300)], "ID long, CLAIM long"),
    }
    for name, df in rows.items():
        df.coalesce(1).write.jdbc(url, name, mode="append", properties=options)
    return url, options, rows


def test_database_order_and_round_trip(spark, derby):
    url, options, rows = derby
    order = files.import_order(spark, url, "APP", options)
    assert order == ["DEPTS", "CLAIMS", "NOTES", "ALONE"]
    for name, df in rows.items():
        got = files.database_ranges(spark, url, name, "ID", 6, options)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.database_ranges(spark, url, "ALONE", "ID", 6, options).count() == 0


def test_ranges_are_even_and_filters_are_pushed(spark, derby):
    url, options, _ = derby
    got = files.database_ranges(spark, url, "NOTES", "ID", 5, options)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert 4 <= len(sizes) <= 6 and max(sizes) <= 120
    plan = files.database_ranges(spark, url, "CLAIMS", "ID", 5, options).filter("N = 3").select("ID")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(N,3)" in plan and "ReadSchema: struct<ID:bigint>" in plan
