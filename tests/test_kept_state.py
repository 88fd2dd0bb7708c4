import random

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import change_tree, kept_windows
from flowsieve.operators.windows import ProbeSettings, probe_windows
from flowsieve.plans.stand_in import event_records

DAY = ProbeSettings(window_minutes=1440)


@pytest.mark.parametrize("cut", ["pmod(xxhash64(row_id), 4)", "least(dayofmonth(ts) div 8, 3)", "0"])
def test_windows_after_any_cut_into_appends(spark, sf_dir, tmp_path, cut):
    events = event_records(spark, sf_dir).withColumn("cut", F.coalesce(F.expr(cut), F.lit(0))).persist()
    store = kept_windows.WindowStore(spark, str(tmp_path), DAY)
    for number in range(4):
        store.append(events.where(F.col("cut") == number), number)
        if number == 2:
            store.append(events.where(F.col("cut") == number), number)
    wanted = probe_windows(events, DAY)
    rows = lambda frame: sorted(tuple(r) for r in frame.select(wanted.columns).collect())
    assert rows(store.windows(3)) == rows(wanted)
    assert rows(store.windows(1)) == rows(probe_windows(events.where("cut <= 1"), DAY))


def test_an_append_writes_only_the_days_it_touches(spark, sf_dir, tmp_path):
    events = event_records(spark, sf_dir).where("ts IS NOT NULL").persist()
    store = kept_windows.WindowStore(spark, str(tmp_path), DAY)
    store.append(events, 0)
    store.append(events.orderBy("ts").limit(3), 1)
    days = [p.name for p in (tmp_path / "append=1").iterdir() if p.name.startswith("day=")]
    assert 1 <= len(days) <= 3 < len([p for p in (tmp_path / "append=0").iterdir() if p.name.startswith("day=")])


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, v double, w string")


def test_changed_cells_and_keys(spark, tmp_path):
    rng = random.Random(3)
    old = [(f"k{i}", float(i), rng.choice("ab")) for i in range(3000)] + [("twice", 1.0, "a"), ("twice", 1.0, "a"), (None, 5.0, None)]
    gone, other, new = {f"k{i}" for i in range(7)}, {f"k{i}" for i in range(100, 109)}, [(f"n{i}", 0.0, "c") for i in range(5)]
    later = [(k, v + 1 if k in other else v, w) for k, v, w in old if k not in gone] + new
    later.remove(("twice", 1.0, "a"))
    rng.shuffle(later)
    paths = [str(tmp_path / p) for p in "ab"]
    for rows, path in zip((old, later), paths):
        change_tree.write_version(table(spark, rows), path, "id")
    wanted = {k: "removed" for k in gone} | {k: "changed" for k in other} | {k: "added" for k, *_ in new} | {"twice": "changed"}
    assert {r.id: r.change for r in change_tree.changed_keys(spark, *paths, "id").collect()} == wanted
    cell = lambda rows: {r.id: r.c for r in table(spark, rows).select("id", change_tree.cell_of(F.col("id")).alias("c")).collect()}
    cells = cell(old) | cell(later)
    found = {r.cell: r for r in change_tree.changed_cells(spark, *paths).collect()}
    assert set(found) == {cells[k] for k in wanted}
    for c, r in found.items():
        assert (r.rows_before, r.rows_after) == tuple(sum(cells[k] == c for k, *_ in rows) for rows in (old, later))


def test_equal_parts_are_not_read(spark, tmp_path):
    old = [(f"k{i}", 0.0, "a") for i in range(2000)]
    paths = [str(tmp_path / p) for p in "ab"]
    for path, first in zip(paths, (0.0, 1.0)):
        change_tree.write_version(table(spark, [("k0", first, "a"), *old[1:]]), path, "id")
    cells = [r.cell for r in change_tree.changed_cells(spark, *paths).collect()]
    assert len(cells) == 1
    read = change_tree.cell_rows(spark, paths[0], cells)
    metrics = read._jdf.queryExecution().executedPlan()
    assert 0 < read.count() < 20
    scan = metrics.toString()
    assert "PartitionFilters" in scan and "__cell" in scan[scan.index("PushedFilters") :]
    parts = {r.f for r in read.select(F.regexp_extract(F.input_file_name(), "__node=([0-9]+)", 1).alias("f")).collect()}
    assert parts == {str(cells[0] >> 8)}


def test_equal_versions_and_an_empty_one(spark, tmp_path):
    rows = [(f"k{i}", float(i), "a") for i in range(50)]
    paths = [str(tmp_path / p) for p in "abc"]
    for path, content in zip(paths, (rows, rows[::-1], [])):
        change_tree.write_version(table(spark, content), path, "id")
    assert change_tree.changed_cells(spark, *paths[:2]).count() == 0
    assert change_tree.changed_keys(spark, *paths[:2], "id").count() == 0
    assert {r.change for r in change_tree.changed_keys(spark, paths[0], paths[2], "id").collect()} == {"removed"}
