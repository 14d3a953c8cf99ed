"""Sources, cell mode and table operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions import aggregates as A
from tabulon.operators import cells as C
from tabulon.operators import lookups as L
from tabulon.operators import ordering as O
from tabulon.operators import reconcile as R
from tabulon.operators.criteria import column_at, criterion, grid_condition, where, wildcard
from tabulon.sources.tables import parsed_input, read_table, safe_export, strict_number, write_table
from tabulon.sources.xlsx import address, letters, write_workbook


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,amount\n"x, ""y""",007\nz,\n')
    df = read_table(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [('x, "y"', "007"), ("z", None)]
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, {"a": null, "c": {"d": 2}}]')
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "a.json")).collect()][0][:2] == ("1", "x")
    write_table(df, str(tmp_path / "out"), "csv")
    assert read_table(spark, str(tmp_path / "out"), "csv").count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "a.parquet")


def test_ragged_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2,EXTRA\n\n3\na,b\n")
    df = read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a", "b", "_c2"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "EXTRA"), (None, None, None), ("3", None, None), ("a", "b", None)]
    (tmp_path / "b.csv").write_text('a,b\n"1\n2",x,"y,z"\n')
    df = read_table(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["a", "b", "_c2"] and [tuple(r) for r in df.collect()] == [("1\n2", "x", "y,z")]
    (tmp_path / "c.csv").write_text('a,A,,"x, y"\n1,2,3,"4, ""5"""\n')
    df = read_table(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["a0", "A1", "_c2", "x, y"] and [tuple(r) for r in df.collect()] == [("1", "2", "3", '4, "5"')]
    (tmp_path / "d.csv").write_text("")
    assert read_table(spark, str(tmp_path / "d.csv")).count() == 0
    (tmp_path / "many").mkdir()
    for name in "xy":
        (tmp_path / "many" / name).write_text(f"a|b\n{name}|1\na|b\n")
    df = read_table(spark, str(tmp_path / "many"), "csv", delimiter="pipe")
    assert sorted(tuple(r) for r in df.collect()) == [("a", "b"), ("a", "b"), ("x", "1"), ("y", "1")]


def test_json_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"z": 1, "b": "x"}, {"b": null, "a": {"d": 2}}]')
    df = read_table(spark, str(tmp_path / "a.json"))
    assert df.columns == ["z", "b", "a"] and [tuple(r) for r in df.collect()] == [("1", "x", ""), ("", "", '{"d":2}')]
    (tmp_path / "b.json").write_text('[["a", 1],\n ["b", null, true]]')
    df = read_table(spark, str(tmp_path / "b.json"))
    assert df.columns == ["_c0", "_c1", "_c2"] and [tuple(r) for r in df.collect()] == [("a", "1", ""), ("b", "", "true")]
    write_table(df.withColumnRenamed("_c1", "A"), str(tmp_path / "out"), "json")
    assert read_table(spark, str(tmp_path / "out"), "json").columns == ["_c0", "A", "_c2"]
    for i, text in enumerate(("", "[1, 2]", '[{"a": 1', "words")):
        (tmp_path / f"bad{i}.json").write_text(text)
        with pytest.raises(Exception):
            read_table(spark, str(tmp_path / f"bad{i}.json")).collect()


def test_column_at(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `2` int, amount int")
    assert [column_at(df, w) for w in ("AMOUNT", "2", "1", "B", "c", "a")] == ["amount", "2", "a", "2", "amount", "a"]
    for wanted in ("0", "4", "D", "", "total"):
        with pytest.raises(ValueError):
            column_at(df, wanted)


def test_fill_and_export(spark):
    schema = "sheet string, row long, col int, formula string, kind string, value string"
    book = spark.createDataFrame([("S", 0, 0, None, "text", "old"), ("S", 5, 1, None, "number", "7"), ("S", 6, 1, "SUM(B1:B6)", "number", "7"), ("T", 0, 0, None, "text", "t")], schema)
    table = spark.createDataFrame([("x", 0, 0, None, "text", 'a "b"'), ("x", 0, 1, "1+1", "number", "2"), ("x", 1, 1, None, "bool", "TRUE")], schema)
    found = {(r.sheet, r.row, r.col): (r.formula, r.kind, r.value) for r in C.fill(book, table, "S", 0, 0).collect()}
    assert found[("S", 0, 0)] == (None, "text", 'a "b"') and found[("S", 0, 1)] == (None, "text", "1+1") and len(found) == 6
    cleared = {(r.sheet, r.row, r.col) for r in C.fill(book, table, "S", 0, 0, clear=True).collect()}
    assert cleared == {("S", 0, 0), ("S", 0, 1), ("S", 1, 1), ("S", 6, 1), ("T", 0, 0)}
    texts = {r.json for r in C.cell_json(book.union(table)).collect()}
    assert '{"cell":"B7","formula":"=SUM(B1:B6)","value":7.0}' in texts and '{"cell":"A1","value":"a \\"b\\""}' in texts and '{"cell":"B2","value":true}' in texts
    letters_of = spark.range(18278).select("id", C.column_letters("id").alias("name")).collect()
    assert all(letters(r["id"]) == r["name"] for r in letters_of)


def test_nested_rows_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), (None, "a")], "p string, c string")
    found = {(r.ancestor, r.node): r.level for r in O.descendants(edges, "p", "c").collect()}
    assert len(found) == 9 and found[("a", "c")] == 2 and found[("a", "a")] == 3


def test_workbook_round_trip(spark, tmp_path):
    rows = [("S", 0, 0, None, "text", "a & b"), ("S", 0, 1, None, "number", "2.5"), ("S", 2, 27, "=SUM(A1:B1)", "number", "2.5"), ("T", 0, 0, None, "bool", "TRUE"), ("T", 1, 0, None, "error", "#N/A")]
    cells = spark.createDataFrame(rows, "sheet string, row long, col int, formula string, kind string, value string")
    path = str(tmp_path / "book.xlsx")
    write_workbook(cells, path)
    back = read_table(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert letters(27) == "AB" and address("AB3") == (2, 27)


def test_criteria(spark):
    df = spark.createDataFrame([("North",), ("northwest",), ("",), (None,), ("a*b",)], "t string")
    count = lambda w: df.filter(criterion("t", w, "text")).count()
    assert [count(w) for w in ("north", "north*", "<>north", "", "a~*b", "n*t")] == [1, 2, 4, 2, 1, 1]
    numbers = spark.createDataFrame([(1.0,), (None,), (5.0,)], "n double")
    assert [numbers.filter(criterion("n", w)).count() for w in (5, ">1", "<>5", "", "x")] == [1, 1, 2, 1, 0]
    assert wildcard("a?~?*") == r"(?is)^a.\?.*$"


def test_where(spark):
    df = spark.createDataFrame([("paid ", "$1,200.00", "Stripe fee"), ("open", "(500)", "x"), ("PAID", "n/a", "stripe")], "Status string, Amount string, ` Vendor ` string")
    assert where(df, "status=Paid").count() == 2
    assert where(df, "amount<0").count() == 1 and where(df, "amount!=0").count() == 2
    assert where(df, "vendor~STRIPE", "status=paid").count() == 2
    with pytest.raises(ValueError):
        where(df, "nothing=1")


def test_grid_conditions(spark):
    df = spark.createDataFrame([("5",), ("",), (None,), ("Abc",)], "t string")
    keep = lambda *a: df.filter(grid_condition(F.col("t"), *a, text=True)).count()
    assert [keep("empty"), keep("lt", 3), keep("between", 9, 1), keep("contains", "B")] == [2, 1, 1, 1]


def test_sorting_and_pages(spark):
    df = spark.createDataFrame([("item10", 1), ("item9", 2), (None, 3), ("", 4)], "t string, k int")
    assert [r["k"] for r in O.sort_rows(df, ("t", "asc"), text=("t",), tie="k").collect()] == [2, 1, 3, 4]
    assert [r["k"] for r in O.page(df.orderBy("k"), 9, 3).collect()] == [4]
    assert O.search(df, "", "k", ["t"]).count() == 0


def test_lookups(spark):
    left = spark.createDataFrame([(0.5,), (3.0,), (9.0,), (None,)], "x double")
    right = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (5.0, "c")], "k double, v string")
    for buckets in (1, 3):
        assert {r["x"]: r["found"] for r in L.lookup_sorted(left, "x", right, "k", "v", buckets=buckets).collect()} == {0.5: None, 3.0: "b", 9.0: "c", None: None}
        assert {r["x"]: r["found"] for r in L.lookup_sorted(left, "x", right, "k", "v", True, buckets=buckets).collect()} == {0.5: "a", 3.0: "b", 9.0: None, None: None}


def test_reconcile(spark):
    left = spark.createDataFrame([("Order #1", "10.00"), ("2", "5"), ("3", "x"), ("4", "1"), ("4", "2")], "k string, v string")
    right = spark.createDataFrame([("1", "10.005"), ("2", "6"), ("3", "y"), ("5", "1")], "k string, v string")
    got = {r["key"]: r["status"] for r in R.reconcile(left, right, "k", ["v"], 0.01, "digits").collect()}
    assert got == {"1": "diff", "2": "diff", "3": "diff", "4": "only_left", "5": "only_right"}
    found = R.reconcile(left, right, "k", ["v"], 0.01, "digits")
    assert {r["key"]: r["material"] for r in found.collect()} == {"1": False, "2": True, "3": True, "4": True, "5": True}  # a tolerance excuses
    assert {(r["key"], r["within_tolerance"]) for r in R.column_diffs(found, ["v"], 0.01).collect()} == {("1", True), ("2", False), ("3", False)}
    one = found.filter("key = '1'")
    assert not R.is_material(one) and R.is_material(one, strict=True) and R.is_material(found)
    assert R.compared_columns(left, right, "k") == ["v"]
    with pytest.raises(ValueError):
        R.compared_columns(left, right, "k", ["w"])
    assert R.duplicate_keys(left, "k").count() == 1
    texts = spark.createDataFrame([("ref AB12 paid",), ("ab12 again",), ("zz",)], "t string")
    keys = spark.createDataFrame([("ab-12",), ("z",), ("",)], "k string")
    assert {r["left_key"]: r["n_candidates"] for r in R.contained(keys, texts, "k", "t").collect()} == {"AB12": 2, "Z": 1}


def test_cells(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, None, False)], "k int, t string, b boolean")
    cells = C.to_cells(rows, "s", "k", ["k", "t", "b"])
    assert cells.count() == 5
    assert C.fingerprint(cells).first() == C.fingerprint(cells.repartition(3)).first()
    moved = C.insert_rows(cells, "s", 1, 1)
    assert C.diff_cells(cells, moved).count() == 4 and C.diff_rows(cells, moved).count() == 0
    assert C.insert_rows(moved, "s", 1, -1).exceptAll(cells).count() == 0


def test_inputs(spark):
    df = spark.createDataFrame([("=A1",), ("true",), ("'5",), ("1e3",), (" 5",), ("",)], "t string")
    assert [tuple(r["p"]) for r in df.select(parsed_input(F.col("t")).alias("p")).collect()] == [("formula", "=A1"), ("bool", "TRUE"), ("text", "5"), ("number", "1e3"), ("text", " 5"), ("empty", "")]
    strict = spark.createDataFrame([("12.50",), ("012",), ("1.5",), ("-3",)], "t string")
    assert [r[0] for r in strict.select(strict_number(F.col("t"))).collect()] == [12.5, None, None, -3.0]
    assert spark.createDataFrame([("=1+1",)], "t string").select(safe_export(F.col("t"))).first()[0] == "'=1+1"


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    row = df.agg(*(A.agg(n, "x").alias(n.replace(".", "_")) for n in A.AGGREGATES)).first().asDict()
    assert row["SUM"] == 0 and row["COUNT"] == 0 and row["MAX"] == 0 and row["AVERAGE"] is None and row["VAR_S"] is None and row["SKEW"] is None


def test_places(spark):
    rows = [(k, None if k % 7 == 0 else float(k * 37 % 101)) for k in range(1000)]
    table = spark.createDataFrame(rows, "k long, x double").repartition(5)
    got = {r["k"]: r["place"] for r in O.with_places(table, *O.sort_order(("x", "desc"), tie="k")).collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])))}
    assert O.with_places(table.limit(0), "k").count() == 0


def plain_claims(left, right):
    """(left row, status, candidates) in the order of the left rows; one with a single candidate claims it."""
    used, found = set(), {}
    for l, key in sorted(left):
        near = [r for r, text in right if r not in used and key and key.lower() in text.lower()]
        used |= set(near) if len(near) == 1 else set()
        found[l] = ("only_left" if not near else "matched" if len(near) == 1 else "ambiguous", sorted(near))
    return found, {r for r, _ in right} - used


def test_reconcile_contains(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    left = [(i, word(rng.randint(0, 5))) for i in range(40)] + [(40, "q" * 70 + "x"), (41, "q" * 70 + "y")]
    right = [(i, word(rng.randint(0, 7)).upper()) for i in range(30)] + [(30, "Q" * 70 + "X")]
    found = R.reconcile_contains(spark.createDataFrame(left, "l int, key string"), spark.createDataFrame(right, "r int, text string"), "key", "text", "l", "r").collect()
    wanted, free = plain_claims(left, right)
    got = {}
    for r in found:
        if r["left_row"] is not None:
            status, near = got.setdefault(r["left_row"], (r["status"], []))
            near += [r["right_row"]] * (r["right_row"] is not None)
    assert {k: (s, sorted(n)) for k, (s, n) in got.items()} == wanted
    assert {r["right_row"] for r in found if r["left_row"] is None} == free
    assert got[40] == ("matched", [30]) and got[41] == ("only_left", [])
    empty = spark.createDataFrame([], "l int, key string")
    assert R.reconcile_contains(empty, empty.toDF("r", "text"), "key", "text", "l", "r").count() == 0


def test_verify_ranges(spark):
    cells = spark.createDataFrame([("s", r, 0, None, "error" if r == 9000 else "number", "#N/A" if r == 9000 else "1.5") for r in range(10000)], "sheet string, row long, col int, formula string, kind string, value string")
    rows = [("sum", "s", 100, 0, 8999, 3, "sum", 8900 * 1.5, None), ("count", "s", 0, 0, 9999, 0, "count", 9999.0, None), ("clean", "s", 0, 0, 8999, 0, "no_error", None, None), ("error", "s", 9000, 0, 9000, 0, "no_error", None, None), ("none", "t", 0, 0, 9, 9, "sum", 0.0, None), ("unknown", "s", 0, 0, 1, 1, "what", 0.0, None)]
    ranges = spark.createDataFrame(rows, "label string, sheet string, top long, left int, bottom long, right int, `check` string, number double, tolerance double")
    assert {r["label"]: r["passed"] for r in C.verify_ranges(cells, ranges).collect()} == {"sum": True, "count": True, "clean": True, "error": False, "none": True, "unknown": False}


def test_percentile_exc(spark):
    rows = [("a", float(v)) for v in (3, 1, 2, 2, 9)] + [("b", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert {r["g"]: r["value"] for r in A.percentile_exc(df, "x", 0.4, ["g"]).collect()} == {"a": 2.0, "b": None, "c": None}
    assert {r["g"]: r["value"] for r in A.percentile_exc(df, "x", 0.75, ["g"]).collect()} == {"a": 6.0, "b": None, "c": None}
