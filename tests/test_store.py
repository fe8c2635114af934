"""A stored table of elements: what a change rewrites, what it leaves, and writers that meet or die."""

from pathlib import Path

import pytest
from imgframe.operators.elements import ELEMENTS, Operation, apply
from imgframe.operators.store import ConflictError, ElementStore
from imgframe.sources import codec


def rows(n):
    return [r for i in range(n) for r in ((i, "(0008,0060)", 0x00080060, "CS", ["MR"]), (i, "(0010,0010)", 0x00100010, "PN", [f"N{i}"]), (i, "(0040,A730)", 0x0040A730, "SQ", []), (i, "(0040,A730)[0].(0008,0100)", 0x00080100, "SH", ["c"]))]


def held(frame):
    return sorted(map(str, frame.select("instance", "path", "tag", "vr", "values").collect()))


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


@pytest.fixture
def store(spark, tmp_path):
    folder = tmp_path / "store"
    return ElementStore.create(spark.createDataFrame(rows(200), ELEMENTS), f"file://{folder}", 16), folder


OPS = [Operation("set", "(0010,0010)", "X"), Operation("remove", "(0040,A730)"), Operation("set", "(0040,A730)[0].(0008,0104)", "m", "LO")]


def test_only_touched_buckets_are_rewritten(spark, store):
    store, folder = store
    before = files(folder)
    assert len(before) == 16 and held(store.elements()) == held(spark.createDataFrame(rows(200), ELEMENTS))
    few = spark.createDataFrame([(7,), (42,)], "instance long")
    touched = store.change(OPS, few)
    after = files(folder)
    assert 1 <= len(touched) <= 2 and len(after) == 16
    assert len(set(before.items()) & set(after.items())) == 16 - len(touched)
    plain = spark.createDataFrame(rows(200), ELEMENTS)
    want = held(apply(plain.where("instance IN (7, 42)"), OPS)) + held(plain.where("instance NOT IN (7, 42)"))
    assert held(store.elements()) == sorted(want) == held(ElementStore.open(spark, str(store.folder)).elements())


def test_no_shuffle_by_instance(spark, store):
    """Updates of all data sets, their encoding and groupings read their buckets in place."""
    table = store[0].elements()
    for frame in (apply(table, OPS), codec.encode_datasets(table), table.groupBy("instance").count()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert codec.decode_datasets(codec.encode_datasets(table), "instance", "data").count() == 800


def test_put(spark, store):
    store, _ = store
    new = spark.createDataFrame([(7, "(0010,0010)", 0x00100010, "PN", ["new"]), (1000, "(0010,0010)", 0x00100010, "PN", ["more"]), (None, "(0010,0010)", 0x00100010, "PN", ["none"])], ELEMENTS)
    store.put(new)
    found = held(store.elements())
    assert len(found) == 200 * 4 - 4 + 2 and sum("new" in f or "more" in f for f in found) == 2
    assert store.put(new.where("false")) == [] and store.change(OPS, spark.createDataFrame([], "instance long")) == []


def test_writers_that_meet_or_die(spark, store):
    first, folder = store
    second = ElementStore.open(spark, first.folder)
    first.change(OPS[:1], spark.createDataFrame([(7,)], "instance long"))
    with pytest.raises(ConflictError):
        second.change(OPS[:1], spark.createDataFrame([(8,)], "instance long"))
    assert sum("'X'" in f for f in held(first.elements())) == 1
    leftover = folder / "data" / "version=2"  # of a writer that died before its manifest
    leftover.mkdir()
    (leftover / "part-00000-x_00003.c000.snappy.parquet").write_bytes(b"half a file")
    again = ElementStore.open(spark, first.folder)
    assert held(again.elements()) == held(first.elements())
    again.change(OPS[:1], spark.createDataFrame([(8,)], "instance long"))
    assert sum("'X'" in f for f in held(again.elements())) == 2
    # One that died after its manifest has left files behind, which opening deletes.
    stale = next((folder / "data" / "version=0").glob("part-*"))
    bucket = next(b for b, v in enumerate(again.manifest["current"]) if v > 0)
    (stale.parent / f"part-00000-y_{bucket:05d}.c000.snappy.parquet").write_bytes(stale.read_bytes())
    assert held(ElementStore.open(spark, first.folder).elements()) == held(again.elements())


def test_empty_and_bad(spark, tmp_path):
    empty = ElementStore.create(spark.createDataFrame([], ELEMENTS), f"file://{tmp_path}/e", 3)
    assert held(empty.elements()) == []
    empty.put(spark.createDataFrame(rows(2), ELEMENTS))
    assert len(held(empty.elements())) == 8
    with pytest.raises(ConflictError):
        ElementStore.create(spark.createDataFrame([], ELEMENTS), f"file://{tmp_path}/e", 3)
    with pytest.raises(FileNotFoundError):
        ElementStore.open(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="one bucket"):
        ElementStore.create(spark.createDataFrame([], ELEMENTS), f"file://{tmp_path}/f", 0)
