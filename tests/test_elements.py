"""Operations on elements, on rows that the tables do not hold."""

import pytest
from imgframe.operators import elements as E
from imgframe.operators import meta as M


@pytest.mark.parametrize("flip", [False, True])
def test_upsert_keeps_the_last(spark, flip):
    """Several rows of one instance and path: the last new one stands, else the last old one, whatever the order of rows."""

    def rows(*found):
        found = [(i, p, 1, "LO", [v], n) for i, p, v, n in found]
        return spark.createDataFrame(found[::-1] if flip else found, E.ELEMENTS + ", n long").coalesce(1)

    old = rows((1, "a", "x", 9), (1, "b", "first", 1), (1, "b", "last", 3), (1, "b", "mid", 2))
    new = rows((1, "a", "mid", 2), (1, "a", "last", 3), (1, "a", "first", 1), (2, "a", "only", 1))
    out = E.upsert(old, new, ["n"])
    assert out.columns and set(out.columns) == {"instance", "path", "tag", "vr", "values"}
    assert sorted((r.instance, r.path, r["values"][0]) for r in out.collect()) == [(1, "a", "last"), (1, "b", "last"), (2, "a", "only")]


NESTED = [(1, "(0040,A730)", 0x0040A730, "SQ", []), (1, "(0040,A730)[0].(0008,0100)", 0x00080100, "SH", ["a"]), (1, "(0010,0010)", 0x00100010, "PN", ["x"]), (1, "(0028,0010)", 0x00280010, "US", ["5"]), (2, "(0010,0010)", 0x00100010, "PN", [])]


def after(spark, *ops, strict=False, rows=NESTED):
    out = E.apply(spark.createDataFrame(rows, E.ELEMENTS), [E.Operation(*op[:3], **(op[3] if len(op) > 3 else {})) for op in ops], strict)
    return sorted((r.instance, r.path, r.vr, "\\".join(r["values"])) for r in out.collect())


BEFORE = sorted((i, p, vr, "\\".join(v)) for i, p, _, vr, v in NESTED)


def test_nested_changes(spark):
    """Sequences and the next item are made; an item further on is not; what a removed sequence held goes too, and can come back."""
    made = after(spark, ("set", "(0040,A730)[1].(0040,A168)[0].(0008,0100)", "c", {"vr": "SH"}))
    assert set(made) - set(BEFORE) == {(i, p, vr, v) for i, n in ((1, 1),) for p, vr, v in ((f"(0040,A730)[{n}].(0040,A168)", "SQ", ""), (f"(0040,A730)[{n}].(0040,A168)[0].(0008,0100)", "SH", "c"))}
    assert set(BEFORE) <= set(made)  # instance 2 has no item 0, so no item 1
    assert after(spark, ("set", "(0040,A730)[5].(0008,0100)", "c"), ("replace", "(0040,A730)[1].(0008,0100)", "c"), ("empty", "(0099,0001)"), ("truncate", "(0099,0001)", 1)) == BEFORE
    again = after(spark, ("remove", "(0040,A730)"), ("set_if_missing", "(0040,A730)[0].(0008,0104)", "m", {"vr": "LO"}), ("push", "(0040,A730)[0].(0008,0104)", "n"))
    nested = [r for r in again if r[1].startswith("(0040")]
    assert nested == [(i, p, vr, v) for i in (1, 2) for p, vr, v in (("(0040,A730)", "SQ", ""), ("(0040,A730)[0].(0008,0104)", "LO", "m\\n"))]
    assert after(spark) == BEFORE and after(spark, ("remove", "(0010,0010)"), rows=[]) == []


def test_strict_changes(spark):
    for bad in (("set", "(0040,A730)[5].(0008,0100)", "c"), ("set", "(0010,0010)[0].(0008,0100)", "c"), ("push", "(0028,0010)", "text"), ("push", "(0040,A730)", 1, {"kind": "u16"})):
        assert after(spark, bad, rows=NESTED[:4]) == BEFORE[:4]
        with pytest.raises(Exception, match="no sequence or item|not a value of"):
            after(spark, bad, strict=True, rows=NESTED[:4])
    with pytest.raises(E.OperationError):
        E.Operation("rename", "(0010,0010)")


def test_one_scan_for_any_number_of_changes(spark, tmp_path):
    path = f"file://{tmp_path}/elements"
    spark.createDataFrame(NESTED, E.ELEMENTS).write.parquet(path)
    ops = [E.Operation("set", f"(0010,00{n:02X})", "x", "LO") for n in range(12)]
    plan = E.apply(spark.read.parquet(path), ops)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_early_stop_reaches_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/elements"
    spark.createDataFrame(NESTED, E.ELEMENTS).write.parquet(path)
    stopped = E.read_until(spark.read.parquet(path), 0x0040A730)
    assert "PushedFilters: [IsNotNull(path), LessThan(path,(0040,A730))]" in stopped._jdf.queryExecution().executedPlan().toString()
    assert {r.path for r in stopped.collect()} == {"(0010,0010)", "(0028,0010)"}
    assert E.read_until(spark.read.parquet(path), 0x0040A730, inclusive=True).count() == len(NESTED)


@pytest.mark.parametrize("op", [("remove", "(0002,0010)"), ("empty", "(0002,0003)"), ("push", "(0002,0013)", "x"), ("set", "(0002,0099)", "x"), ("set", "(0002,0010)[0].(0002,0010)", "x")])
def test_meta_errors(spark, op):
    with pytest.raises(M.MetaError):
        M.apply(spark.range(0), [E.Operation(*op)])


def test_meta_needs_a_syntax(spark):
    row = spark.createDataFrame([("", None, None, " \0")], "media_storage_sop_class_uid string, media_storage_sop_instance_uid string, implementation_class_uid string, transfer_syntax string")
    with pytest.raises(Exception, match="no transfer syntax"):
        M.with_defaults(row, E.F.lit("c"), E.F.lit("i"), "1").collect()


def test_a_sequence_replaces_a_sequence(spark):
    """Items that the new sequence lacks go, at any depth; new elements of an item leave what is beside them."""
    seq, sub = "(0040,A730)", "(0040,A168)"
    old = [(1, seq, 1, "SQ", []), (1, f"{seq}[0].(0008,0100)", 1, "SH", ["a"]), (1, f"{seq}[1].(0008,0100)", 1, "SH", ["b"]), (1, f"{seq}[1].{sub}", 1, "SQ", []), (1, f"{seq}[1].{sub}[0].(0008,0100)", 1, "SH", ["c"]), (2, f"{seq}[1].(0008,0100)", 1, "SH", ["d"]), (1, "(0040,A731)", 1, "LO", ["e"])]
    paths = lambda new: sorted((r.instance, r.path, *r["values"]) for r in E.upsert(spark.createDataFrame(old, E.ELEMENTS), spark.createDataFrame(new, E.ELEMENTS)).collect())
    assert paths([(1, seq, 1, "SQ", []), (1, f"{seq}[0].(0008,0100)", 1, "SH", ["n"])]) == [(1, seq), (1, f"{seq}[0].(0008,0100)", "n"), (1, "(0040,A731)", "e"), (2, f"{seq}[1].(0008,0100)", "d")]
    inner = paths([(1, f"{seq}[1].{sub}", 1, "SQ", [])])
    assert inner == sorted((i, p, *v) for i, p, _, _, v in old if "c" not in v)
    assert paths([(1, f"{seq}[1].(0008,0100)", 1, "SH", ["n"])]) == sorted((i, p, *(["n"] if v == ["b"] else v)) for i, p, _, _, v in old)


def test_private_creators_of_items(spark):
    item = "(0040,A730)[0]."
    rows = [(1, "(0009,0010)", "ROOT"), (1, "(0009,1001)", "a"), (1, f"{item}(0009,0010)", "ITEM"), (1, f"{item}(0009,1001)", "b"), (1, "(0040,A730)[1].(0009,1001)", "c"), (2, "(0009,1001)", "d"), (1, f"{item}(0040,A168)[0].(0009,1001)", "e")]
    frame = spark.createDataFrame([(i, p, E.tag_at(p), "LO", [v]) for i, p, v in rows], E.ELEMENTS)
    got = sorted((r.instance, r["values"][0], r.creator or "") for r in E.private_elements(frame).collect())
    assert got == [(1, "a", "ROOT"), (1, "b", "ITEM"), (1, "c", ""), (1, "e", ""), (2, "d", "")]


def test_unreadable_data_sets_stay(spark):
    rows = [*NESTED, (3, None, None, None, None)]
    assert (3, None, None, None) in [(r.instance, r.path, r.vr, r["values"]) for r in E.apply(spark.createDataFrame(rows, E.ELEMENTS), [E.Operation("remove", "(0010,0010)")]).collect()]
