"""Formulas: dialect, allow-list and hostile input."""

import itertools

import pytest

from millrace.functions.formula import FormulaError, apply_metrics, derive, formula_column


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(100.0, 5, "ab"), (200.0, 10, None), (300.0, 0, "c")], "revenue double, units long, name string")


DIALECT = {
    "log(revenue)": [2.0, 2.301029995663981, 2.477121254719662],
    "units ^ 2": [25.0, 100.0, 0.0],
    "units ** 2 + 1": [26.0, 101.0, 1.0],
    "7 / 2": [3.5, 3.5, 3.5],
    "revenue / units": [20.0, 20.0, None],
    "units % 3": [2, 1, 0],
    "concat(name, '!')": ["ab!", "!", "c!"],
    "substr('abc', 0, 2)": ["a", "a", "a"],
    "substr('abc', 2)": ["bc", "bc", "bc"],
    "len(name)": [2, None, 1],
    "Revenue * UNITS": [500.0, 2000.0, 0.0],
    "CASE WHEN units > 5 THEN 1 ELSE 0 END": [0, 1, 0],
    "if(units > 5, 'hi', 'lo')": ["lo", "hi", "lo"],
    "try_cast(name AS int)": [None, None, None],
    "coalesce(name, 'none')": ["ab", "none", "c"],
    "name = 'a^b'": [False, None, False],
    "not (units between 1 and 6)": [False, True, True],
}


@pytest.mark.parametrize("text", DIALECT)
def test_dialect(sales, text):
    got = [r["v"] for r in derive(sales, "v", text).select("v").collect()]
    assert got == [pytest.approx(w) if isinstance(w, float) else w for w in DIALECT[text]]


def test_columns_match_by_snake_name(spark):
    odd = spark.createDataFrame([(2.0,)], "`Unit Price (USD)` double")
    assert derive(odd, "v", "unit_price_usd * 2").first()["v"] == 4.0
    assert derive(odd, "v", "`Unit Price (USD)` ^ 2").first()["v"] == 4.0


def hostile():
    calls = ["read_csv('/etc/passwd')", "system('id')", "getenv('HOME')", "pragma_version()", "current_user()", "uuid()",
             "input_file_name()", "reflect('java.lang.Runtime', 'getRuntime')", "java_method('a', 'b')", "rand()",
             "version()", "current_database()", "array(units)", "explode(array(units))", "sum(units)", "max(units)",
             "count(*)", "regexp_replace(name, 'a', 'b')", "from_json(name, 'a int')", "raise_error('x')", "sleep(9)"]
    clauses = ["SELECT 1", "(SELECT max(units) FROM t)", "EXISTS(SELECT 1)", "units IN (SELECT 1)", "DROP TABLE t",
               "units; DROP TABLE t", "units -- note", "units /* note */", "COPY t TO 'x'", "ATTACH 'x'", "*", "t.*",
               "units OVER ()", "sum(units) OVER ()", "row_number() OVER (ORDER BY units)", "x -> x + 1", "units::json",
               "name LIKE 'a%'", "name || 'x'", "{'a': 1}", "[1, 2]", "units[0]", "name.field", "$1", "?", ":p", "@x",
               "__import__('os')", "eval('1')", "lambda x: x", "units = ", "(units", "units)", "+", "'''", "units ^ ^ 2",
               "INTERVAL 1 DAY + units FROM t", "missing_column + 1", "VALUES (1)", "map(1, 2)", "struct(units)"]
    wraps = ["{}", "units + {}", "abs({})", "({})", "coalesce({}, 1)", "CASE WHEN units > 1 THEN {} END", "-{}",
             "{} * revenue", "round({}, 2)", "if({} > 1, 1, 2)", "nullif({}, 0)", "greatest({}, 1)", "{} = 1",
             "concat({}, 'x')", "lower({})", "1 / {}", "power({}, 2)"]
    return [w.format(c) for c, w in itertools.product(calls + clauses, wraps)]


def test_hostile_formulas_are_refused(spark, sales):
    texts = hostile()
    assert len(texts) >= 1000
    refused = 0
    for text in texts:
        try:
            formula_column(spark, text, sales.columns)
        except ValueError:
            refused += 1
    assert refused / len(texts) >= 0.99


def test_refusals_name_the_problem(sales):
    for text, word in (("", "empty"), ("nope + 1", "unknown column"), ("left(name, 1)", "not allowed"), ("abs()", "arguments"),
                       ("units units", "not allowed|parse")):
        with pytest.raises(FormulaError, match=word):
            derive(sales, "v", text)


def test_metrics_group_formulas(sales):
    out = apply_metrics(sales, {"total": "revenue * 2", "n": "units"}).first()
    assert (out["total"], out["n"]) == (1200.0, 15)
