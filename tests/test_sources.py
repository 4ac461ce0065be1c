import datetime as dt
import json
from types import SimpleNamespace

import pytest

from factories import day, person, punch
from musterbook.model import EMP_SCHEMA
from musterbook.plans.summary import monthly_summary
from musterbook.session import shared_folder
from musterbook.sources import store
from musterbook.sources.derived import DerivedTables


def test_csv_round_trip(spark, make_tables, tmp_path):
    t = make_tables([person("00000001")], [punch("00000001", day(3), "08:00:00", None)])
    table = monthly_summary(t, day(1), dt.date(2024, 2, 1))
    path = store.summary_csv(table, str(tmp_path), "All", "Senior Resident", "2024-01")
    assert path.endswith("/All_Senior Resident_January_2024.csv")
    back = spark.read.schema(table.schema).option("header", True).csv(path)
    assert back.collect() == table.collect()


def test_json_records(spark, tmp_path):
    file = tmp_path / "emp.json"
    file.write_text(json.dumps([{"emp_id": "1", "creation_date": "2024-01-10"}, {"emp_id": "2", "cat": None, "extra": 1}]))
    rows = store.read_json_records(spark, str(file), EMP_SCHEMA).orderBy("emp_id").collect()
    assert rows[0]["creation_date"] == day(10) and rows[0]["cat"] is None and rows[1]["emp_name"] is None


def test_json_lines_are_split_over_tasks(spark, tmp_path):
    file = tmp_path / "emp.json"
    odd = ["", "broken", '{"cat": null}']
    file.write_text("\n".join([json.dumps({"emp_id": f"{n:08}", "creation_date": "2024-01-10"}) for n in range(20_000)] + odd))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(100_000))
    try:
        rows = store.read_json_records(spark, str(file), EMP_SCHEMA, lines=True)
        assert rows.rdd.getNumPartitions() >= 10
        assert rows.where("emp_id is not null").distinct().count() == 20_000
        assert [r for r in rows.where("emp_id is null").collect() if any(x is not None for x in r)] == []
        assert rows.where("emp_id is null").count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_fields(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": "x", "note": "n"}'), (3, "broken"), (4, None)], "id INT, props STRING")
    rows = store.json_record_fields(df, "props", "k INT, note STRING").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 5, None), (2, None, "n"), (3, None, None), (4, None, None)]


def test_shared_folder_follows_the_cluster():
    def session(master, **settings):
        context = SimpleNamespace(master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=settings.get), sparkContext=context)

    named = session("yarn", **{"spark.checkpoint.dir": "hdfs://name/shared/"})
    assert shared_folder(named, "x").startswith("hdfs://name/shared/x-")
    assert shared_folder(session("local[2]"), "x") != shared_folder(session("local[2]"), "x")
    with pytest.raises(ValueError):
        shared_folder(session("yarn"), "x")


def test_jdbc_range_is_whole_or_absent():
    first, until = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    assert store.jdbc_slices(None, None, None, 4) == {}
    assert store.jdbc_slices("log_date", first, until, 4)["upperBound"] == "2024-02-01"
    for part in (("log_date", None, None), ("log_date", first, None), (None, first, until)):
        with pytest.raises(ValueError):
            store.jdbc_slices(*part, 4)


def test_derived_tables_take_whole_sources(spark):
    folder = "/root/testdata/sf0.001"
    customer, orders, events, supplier = (
        spark.read.parquet(f"{folder}/{name}.parquet") for name in ("customer", "orders", "events", "supplier")
    )
    t = DerivedTables(spark, folder)
    days = orders.selectExpr("o_custkey", "date(o_orderdate)").distinct().count()
    signups = events.where("event_type = 'signup'").selectExpr("user_id", "date(ts)").distinct().count()
    assert t.emp.count() == customer.count()
    assert t.leave.count() == days + signups + supplier.count()
    assert t.attend.join(t.emp, "emp_id", "left_anti").count() >= supplier.count()
