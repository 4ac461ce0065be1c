import datetime as dt
import os

from factories import day, person, punch
from musterbook.plans.summary import summary_all_months, summary_from_sets
from musterbook.sources.day_sets import merge_day_sets, read_day_sets, write_day_sets

AS_OF = dt.date(2024, 4, 1)


def written(folder):
    return {
        os.path.join(place, name): os.stat(os.path.join(place, name)).st_mtime_ns
        for place, _, names in os.walk(folder)
        for name in names
        if name.endswith(".parquet")
    }


def test_merging_days_equals_a_full_run(spark, make_tables, tmp_path):
    emp = [person("1"), person("2"), person("3", created=day(5, 2))]
    old = [punch("1", day(n, m), "08:00:00", None) for n in range(2, 20) for m in (1, 2)]
    old += [punch("2", day(9, 1), "07:00:00", None), punch("2", day(4, 3), "14:30:00", None)]
    # A late fact of February, a punctual second punch of a late day, a repeated row, an unreadable time.
    new = [punch("3", day(20, 2), "08:00:00", None), punch("2", day(4, 3), "07:00:00", None), old[21], punch("1", day(5, 3), "broken", None)]
    old_leave = [("1", day(22, 1), "CL"), ("2", day(12, 2), "EL"), ("2", day(13, 3), None)]
    new_leave = [("1", day(14, 3), "EL"), ("3", day(21, 2), "ZZ"), ("1", day(14, 3), "CL")]
    first = make_tables(emp, old, old_leave, [day(26, 1), day(25, 3)])
    then = make_tables(emp, new, new_leave)
    folder = str(tmp_path / "sets")
    write_day_sets(first.leave, first.attend, folder)
    before = written(folder)
    merge_day_sets(then.leave, then.attend, folder)
    after = written(folder)
    january = [f for f in before if "month=2024-01-01" in f]
    assert january and all(after.get(f) == before[f] for f in january)
    assert not any(f in after for f in before if "month=2024-02-01" in f or "month=2024-03-01" in f)
    merge_day_sets(then.leave, then.attend, folder)  # repeated: nothing changes
    whole = make_tables(emp, old + new, old_leave + new_leave, [day(26, 1), day(25, 3)])
    for options in ({}, {"leave_first": False}, {"placeholders": "active"}):
        got = summary_from_sets(read_day_sets(spark, folder), whole.emp, whole.holidays, AS_OF, "2024-01", **options)
        want = summary_all_months(whole, AS_OF, "2024-01", **options)
        assert got.schema == want.schema
        assert sorted(got.collect()) == sorted(want.collect())


def test_empty_store_and_empty_day(spark, make_tables, tmp_path):
    none, some = make_tables(), make_tables([person("1")], [punch("1", day(3), "08:00:00", None)])
    folder = str(tmp_path / "sets")
    write_day_sets(none.leave, none.attend, folder)
    assert read_day_sets(spark, folder).collect() == []
    merge_day_sets(some.leave, some.attend, folder)
    merge_day_sets(none.leave, none.attend, folder)
    assert [(r.emp_id, r.month, r.punched) for r in read_day_sets(spark, folder).collect()] == [("1", day(1), 4)]
