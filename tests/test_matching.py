"""Identifiers with nested keys, matching inside of items, and many ranges at once."""

import datetime
import random

import duckdb
import pytest
from imgframe.operators import matching as M
from imgframe.operators.elements import ELEMENTS, tag_at
from imgframe.plans import ORACLE_SQL, QUERIES
from imgframe.sources import codec
from tests.compare import assert_same

STEP, CODE = "(0040,A730)", "(0040,A168)"


def rows(instance, *paths):
    return [(instance, p, tag_at(p), "SQ" if v is None else "SH", [] if v is None else [v]) for p, v in paths]


DATA = [
    *rows(1, ("(0010,0010)", "A^B"), (STEP, None), (f"{STEP}[0].(0008,0060)", "MR"), (f"{STEP}[0].(0008,0100)", "x"), (f"{STEP}[1].(0008,0060)", "CT"), (f"{STEP}[1].(0008,0100)", "y")),
    *rows(2, ("(0010,0010)", "A^C"), (f"{STEP}[0].(0008,0060)", "CT"), (f"{STEP}[0].(0008,0100)", "x")),
    *rows(3, (f"{STEP}[2].(0008,0060)", "CT"), (f"{STEP}[2].(0008,0100)", "z"), (f"{STEP}[2].{CODE}[4].(0008,0100)", "deep"), (f"{STEP}[3].{CODE}[0].(0008,0100)", "deep")),
    *rows(4, (f"{STEP}[0].(0008,0060)", "CT"), (f"{STEP}[1].{CODE}[0].(0008,0100)", "deep")),
    *rows(5, ("(0008,0060)", "CT"), ("(0008,0100)", "x")),
]


@pytest.mark.parametrize(
    ("terms", "found"),
    [
        ([f"{STEP}.Modality=CT", f"{STEP}.(0008,0100)=x"], {2}),  # in 1, two items have one each
        ([f"{STEP}.Modality=CT"], {1, 2, 3, 4}),
        ([f"{STEP}.Modality=CT", f"{STEP}.{CODE}.(0008,0100)=d*"], {3}),
        ([f"{STEP}.{CODE}.(0008,0100)=deep"], {3, 4}),
        ([f"{STEP}[0].Modality=CT", f"{STEP}[1].Modality=MR"], {1}),  # two items of the identifier, each met by some item
        ([f"{STEP}.Modality=CT", "PatientName=A*"], {1, 2}),
        (["Modality=CT"], {5}),
        (["PatientName=", f"{STEP}.Modality="], {1, 2, 3, 4, 5}),
        (["PatientName=A*", f"{STEP}.(0008,0100)=", f"{STEP}.Modality=MR\\CT"], {1, 2}),
        ([f"{STEP}.Modality=US"], set()),
    ],
)
def test_items(spark, terms, found):
    out = M.match_in_items(spark.createDataFrame(DATA, ELEMENTS), M.build_identifier(terms))
    assert {r.instance for r in out.collect()} == found
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2


def test_types_in_items(spark):
    """Dates match ranges, numbers match as numbers, whatever their texts look like."""
    data = [(i, p, tag_at(p), vr, [v]) for i, p, vr, v in ((1, f"{STEP}[0].(0008,0020)", "DA", "20200315"), (2, f"{STEP}[0].(0008,0020)", "DA", "20210101"), (3, f"{STEP}[0].(0008,0020)", "DA", "nonsense"), (1, "(0028,0010)", "US", "0512"), (2, "(0028,0010)", "US", "512.0"))]
    known = [*M.SEED, (0x00280010, 0xFFFFFFFF, "Rows", "US")]
    match = lambda *terms: {r.instance for r in M.match_in_items(spark.createDataFrame(data, ELEMENTS), M.build_identifier(list(terms), known)).collect()}
    assert match(f"{STEP}.StudyDate=20200101-20201231") == {1} and match(f"{STEP}.StudyDate=2021-") == {2}
    assert match("Rows=512") == {1, 2}


def test_identifier():
    found = M.build_identifier([f"{STEP}[0].Modality=MR", f"{STEP}[1].{CODE}.(0008,0100)=", "PatientName=X", "PatientName=Y"])
    assert found == [("(0010,0010)", 0x00100010, "PN", ["Y"]), (STEP, 0x0040A730, "SQ", []), (f"{STEP}[0].(0008,0060)", 0x00080060, "CS", ["MR"]), (f"{STEP}[1].{CODE}", 0x0040A168, "SQ", []), (f"{STEP}[1].{CODE}[0].(0008,0100)", 0x00080100, "LO", [])]
    assert {p for p, *_ in codec.decode(codec.encode(found))} == {p for p, *_ in found}  # it can be sent
    for bad in (f"{STEP}[2].Modality=MR", "Nonsense=1", f"{STEP}[0]=x", f"{STEP}[x].Modality=1", "=1", f"{STEP}=x"):
        with pytest.raises(M.QueryError):
            M.build_identifier([bad])


def test_many_ranges(spark):
    rng = random.Random(1)
    day = lambda n: datetime.date(1990, 1, 1) + datetime.timedelta(days=n)
    ranges = [(i, day(a), day(a + rng.choice([0, 1, 7, 8, 9, 63, 64, 500, 5000])), rng.choice([None, "a", "b"])) for i, a in enumerate(rng.choices(range(4000), k=120))]
    ranges += [(200, None, day(30), None), (201, day(3900), None, "a"), (202, None, None, None), (203, day(9), day(3), None), (204, datetime.date(1, 1, 1), datetime.date(9999, 12, 31), "b")]
    instances = [(i, day(n) if i % 50 else None, rng.choice(["a", "b", None])) for i, n in enumerate(rng.choices(range(4200), k=800))]
    got = M.match_many(spark.createDataFrame(ranges, "query int, lo date, hi date, k string"), spark.createDataFrame(instances, "i int, day date, k string"), "day", ("k",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    pairs = sorted((r["query"], r.i) for r in got.collect())
    assert pairs == sorted((q, i) for q, lo, hi, k in ranges for i, d, own in instances if d and (lo is None or lo <= d) and (hi is None or d <= hi) and (k is None or k == own))
    empty = spark.createDataFrame([], "query int, lo date, hi date, k string")
    assert not M.match_many(empty, spark.createDataFrame(instances, "i int, day date, k string"), "day", ("k",)).collect()


def test_few_blocks(spark):
    lengths = [spark.sql(f"SELECT DATE'2000-01-01' AS lo, DATE'2000-01-01' + {n} AS hi").select(M.F.size(M.blocks_of(M.F.col("lo"), M.F.col("hi")))).first()[0] for n in (0, 1, 100, 10_000)]
    assert lengths[:2] == [1, 2] and max(lengths) <= 2 * 7 * 5


def test_far_days(spark):
    """Open ranges, and those up to a last day of all, hold days of any year."""
    far = [(0, datetime.date(1, 1, 1)), (1, datetime.date(2000, 1, 1)), (2, datetime.date(8000, 1, 1)), (3, datetime.date(9999, 12, 31))]
    ranges = [(0, None, None), (1, datetime.date(2000, 1, 1), None), (2, None, datetime.date(8000, 1, 1)), (3, datetime.date(9999, 12, 31), datetime.date(9999, 12, 31))]
    queries, instances = spark.createDataFrame(ranges, "query int, lo date, hi date"), spark.createDataFrame(far, "i int, day date")
    expected = [(q, i) for q, lo, hi in ranges for i, d in far if (lo is None or lo <= d) and (hi is None or d <= hi)]
    assert sorted((r["query"], r.i) for r in M.match_many(queries, instances, "day").collect()) == expected
    totals = M.match_totals(queries, instances, "day", (), ("query",), {"n": (M.F.count("i"), M.F.sum)})
    assert {r["query"]: r.n for r in totals.collect()} == {q: sum(q == p for p, _ in expected) for q in range(4)}


def test_totals(spark):
    """The totals are those of the pairs, with any choice of two keys, one of another integer type than the instances' own."""
    rng = random.Random(2)
    day = lambda n: datetime.date(1990, 1, 1) + datetime.timedelta(days=n)
    ranges = [(i % 90, rng.choice([None, day(a), day(a)]), rng.choice([None, day(a + rng.choice([-3, 0, 1, 7, 8, 63, 64, 500]))]), rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for i, a in enumerate(rng.choices(range(1500), k=150))]
    ranges += ranges[:9]
    instances = [(i if i % 7 else None, rng.choice([None, *[day(n)] * 9]), rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i, n in enumerate(rng.choices(range(1600), k=600))]
    queries, held = spark.createDataFrame(ranges, "query int, lo date, hi date, k string, m int"), spark.createDataFrame(instances, "i long, day date, k string, m long")
    totals = {"n": (M.F.count("i"), M.F.sum), "first": (M.F.min("i"), M.F.min)}
    for keys in (("k", "m"), ("k",), ()):
        got = M.match_totals(queries, held, "day", keys, ("query",), totals)
        met = {}
        for q, lo, hi, *own in ranges:
            found = [i for i, d, *of in instances if d and (lo is None or lo <= d) and (hi is None or d <= hi) and all(a is None or a == b for a, b in list(zip(own, of, strict=True))[: len(keys)])]
            met.setdefault(q, []).extend(found) if found else None
        numbers = {q: [i for i in found if i is not None] for q, found in met.items()}
        assert {r["query"]: (r.n, r["first"]) for r in got.collect()} == {q: (len(x), min(x, default=None)) for q, x in numbers.items()}
    assert not M.match_totals(queries.where("false"), held, "day", ("k",), ("query",), totals).collect()
    assert not M.match_totals(queries, held.where("false"), "day", ("k",), ("query",), totals).collect()


def joined(plan) -> int:
    """How many rows the joins of a plan that has run gave."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return sum(map(joined, below)) + (plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0)


@pytest.fixture
def tables(tmp_path):
    """Writes customers and orders: gives their folder and a connection to them."""

    def make(customers: str, orders: str, name: str = "tables"):
        con, at = duckdb.connect(), tmp_path / name
        at.mkdir()
        for table, rows in (("customer", customers), ("orders", orders)):
            con.execute(f"COPY ({rows}) TO '{at}/{table}.parquet'")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
        return str(at), con

    return make


def test_many_without_pairs(spark, tables):
    """The joins of match_many give as many rows for ten orders of a day and status as for one: its work doesn't grow as the pairs do."""
    rows = []
    for times in (1, 10):
        at, con = tables("SELECT range AS c_custkey FROM range(500)", f"SELECT range AS o_orderkey, TIMESTAMP '1992-01-01' + INTERVAL (range % 2600) DAY AS o_orderdate, ['F', 'O'][range % 2 + 1] AS o_orderstatus FROM range({2600 * times})", f"x{times}")
        frame = QUERIES["match_many"](spark, at)
        assert_same(frame, con, ORACLE_SQL["match_many"])
        rows.append(joined(frame._jdf.queryExecution().executedPlan()))
    assert 0 < rows[0] == rows[1]


def test_many_odd_rows(spark, tables):
    """Customers without a key or twice, orders without a key, a day or a status, and days far from the others."""
    at, con = tables(
        "SELECT CASE WHEN range % 97 > 0 THEN range % 300 - 50 END AS c_custkey FROM range(400)",
        "SELECT CASE WHEN range % 5 > 0 THEN range END AS o_orderkey, CASE WHEN range % 11 = 0 THEN NULL WHEN range % 13 = 0 THEN TIMESTAMP '9999-12-31 23:59:59' WHEN range % 17 = 0 THEN TIMESTAMP '0001-01-01' ELSE TIMESTAMP '1991-12-01 12:00:00' + INTERVAL (range % 2600) DAY END AS o_orderdate, CASE WHEN range % 3 > 0 THEN ['F', 'O'][range % 2 + 1] END AS o_orderstatus FROM range(2000)",
    )
    assert_same(QUERIES["match_many"](spark, at), con, ORACLE_SQL["match_many"])
