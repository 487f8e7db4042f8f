"""User formulas: an allow-list of scalar constructs turned into Spark columns.

Spark parses the text; the tree is then rebuilt node by node as DataFrame columns, so anything
that is not on the list below cannot reach a query. Function names keep the meaning they have in
the SQL dialect users write: ``log`` is base 10, ``^`` and ``**`` are powers, ``concat`` skips NULL,
division by zero is NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.columns import col, snake
from millrace.session import session_of


class FormulaError(ValueError):
    pass


def _substring(text: Column, start: Column, length: Column | None = None) -> Column:
    """1-based substring where position 0 is the place before the first character."""
    if length is None:
        return F.when(start == 0, text).otherwise(F.substring(text, start, F.length(text)))
    kept = F.when(start == 0, length - 1).otherwise(length)
    return F.substring(text, F.greatest(start, F.lit(1)), F.greatest(kept, F.lit(0)))


def _round(value: Column, digits: Column | None = None) -> Column:
    return F.round(value, digits if digits is not None else 0)


_UNARY = {
    "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sign": F.signum, "sqrt": F.sqrt, "cbrt": F.cbrt,
    "exp": F.exp, "ln": F.ln, "log2": F.log2, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "lower": F.lower, "upper": F.upper,
    "length": F.length, "len": F.length,
}
_FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    **{name: (1, 1, function) for name, function in _UNARY.items()},
    "log": (1, 1, F.log10),
    "round": (1, 2, _round),
    "power": (2, 2, F.pow),
    "pow": (2, 2, F.pow),
    "mod": (2, 2, F.try_mod),
    "pi": (0, 0, F.pi),
    "coalesce": (1, 64, F.coalesce),
    "ifnull": (2, 2, F.coalesce),
    "nullif": (2, 2, F.nullif),
    "greatest": (2, 64, F.greatest),
    "least": (2, 64, F.least),
    "if": (3, 3, lambda test, yes, no: F.when(test, yes).otherwise(no)),
    "trim": (1, 1, F.trim),
    "ltrim": (1, 1, F.ltrim),
    "rtrim": (1, 1, F.rtrim),
    "concat": (1, 64, lambda *parts: F.concat_ws("", *[p.cast("string") for p in parts])),
    "substr": (2, 3, _substring),
    "substring": (2, 3, _substring),
    "replace": (3, 3, F.replace),
}
_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "Add": lambda a, b: a + b,
    "Subtract": lambda a, b: a - b,
    "Multiply": lambda a, b: a * b,
    "Divide": F.try_divide,
    "Remainder": F.try_mod,
    "EqualTo": lambda a, b: a == b,
    "GreaterThan": lambda a, b: a > b,
    "GreaterThanOrEqual": lambda a, b: a >= b,
    "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b,
    "And": lambda a, b: a & b,
    "Or": lambda a, b: a | b,
}
AGGREGATE_BOUNDS = ("min", "max")

_OPERAND = r"`[^`]+`|[\w.]+(?:\([^()]*\))?|\((?:[^()]|\([^()]*\))*\)"
_POWER = re.compile(rf"({_OPERAND})\s*(?:\*\*|\^)\s*(-?(?:{_OPERAND}))")
_BARE_TEXT_TYPE = re.compile(r"(?i)\b(?:varchar|text)\b(?!\s*\()(?=\s*\))")
_LITERAL = re.compile(r"'(?:[^']|'')*'")
_CAST_TYPES = re.compile(
    r"(?i)(tinyint|smallint|int|integer|bigint|float|real|double|boolean|bool|string|varchar|text|date|"
    r"timestamp|decimal\(\d+,\s*\d+\))\Z"
)


def _rewrite_powers(text: str) -> str:
    """``a ^ b`` and ``a ** b`` as ``power(a, b)``; text literals stay as they are."""
    saved: list[str] = []

    def keep(match: re.Match) -> str:
        saved.append(match.group(0))
        return f"'§{len(saved) - 1}'"

    bare = _BARE_TEXT_TYPE.sub("string", _LITERAL.sub(keep, text))
    for _ in range(32):
        changed = _POWER.sub(r"power(\1, \2)", bare, count=1)
        if changed == bare:
            break
        bare = changed
    if "^" in bare or "**" in bare:
        raise FormulaError(f"write the power as power(a, b): {text!r}")
    return re.sub(r"'§(\d+)'", lambda m: saved[int(m.group(1))], bare)


def _lookup(names: Sequence[str]) -> dict[str, str]:
    table: dict[str, str] = {}
    for name in names:
        table.setdefault(snake(name), name)
    for name in names:
        table[name.lower()] = name
    return table


class _Builder:
    def __init__(self, names: Sequence[str], text: str, aggregates: bool):
        self.names = _lookup(names)
        self.text = text
        self.aggregates = aggregates

    def refuse(self, what: str) -> FormulaError:
        return FormulaError(f"{what} is not allowed in a formula: {self.text!r}")

    def build(self, node) -> Column:
        kind = node.getClass().getSimpleName()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if kind == "Literal":
            return F.expr(node.sql())
        if kind == "UnresolvedAttribute":
            return self.column(node)
        if kind == "UnresolvedFunction":
            return self.call(node, kids)
        if kind in _BINARY and len(kids) == 2:
            return _BINARY[kind](self.build(kids[0]), self.build(kids[1]))
        if kind == "UnaryMinus":
            return -self.build(kids[0])
        if kind == "UnaryPositive":
            return self.build(kids[0])
        if kind == "Not":
            return ~self.build(kids[0])
        if kind == "IsNull":
            return self.build(kids[0]).isNull()
        if kind == "IsNotNull":
            return self.build(kids[0]).isNotNull()
        if kind == "CaseWhen":
            return self.case(kids)
        if kind == "Cast":
            return self.cast(node, kids[0])
        if kind in ("StringTrim", "StringTrimLeft", "StringTrimRight") and len(kids) == 1:
            return {"StringTrim": F.trim, "StringTrimLeft": F.ltrim, "StringTrimRight": F.rtrim}[kind](
                self.build(kids[0]))
        if kind == "Between" or kind == "UnresolvedBetween":
            return self.build(kids[0]).between(self.build(kids[1]), self.build(kids[2]))
        raise self.refuse(kind)

    def column(self, node) -> Column:
        parts = [node.nameParts().apply(i) for i in range(node.nameParts().size())]
        name = self.names.get(".".join(parts).lower())
        if name is None:
            raise FormulaError(f"unknown column {'.'.join(parts)!r} in formula {self.text!r}")
        return col(name)

    def call(self, node, kids) -> Column:
        parts = [node.nameParts().apply(i) for i in range(node.nameParts().size())]
        word = parts[0].lower() if len(parts) == 1 else ".".join(parts)
        if node.isDistinct() or node.filter().isDefined():
            raise self.refuse("an aggregate clause")
        args = [self.build(k) for k in kids]
        if word == "between" and len(args) == 3:
            return args[0].between(args[1], args[2])
        if word in AGGREGATE_BOUNDS and self.aggregates and len(args) == 1:
            return {"min": F.min, "max": F.max}[word](args[0])
        if word not in _FUNCTIONS:
            raise self.refuse(f"function {word!r}")
        fewest, most, function = _FUNCTIONS[word]
        if not fewest <= len(args) <= most:
            raise FormulaError(f"wrong number of arguments for {word!r}: {self.text!r}")
        return function(*args)

    def case(self, kids) -> Column:
        built = [self.build(k) for k in kids]
        out = F.when(built[0], built[1])
        for i in range(2, len(built) - 1, 2):
            out = out.when(built[i], built[i + 1])
        return out.otherwise(built[-1]) if len(built) % 2 else out

    def cast(self, node, kid) -> Column:
        target = node.dataType().sql().lower()
        if not _CAST_TYPES.match(target):
            raise self.refuse(f"a cast to {target}")
        inner = self.build(kid)
        attempt = node.evalMode().toString().upper() == "TRY"
        return inner.try_cast(target) if attempt else inner.cast(target)


def formula_column(
    spark: SparkSession, text: str, names: Sequence[str], aggregates: bool = False
) -> Column:
    """The formula as a column over a table with these column names, or a ValueError."""
    clean = str(text or "").strip()
    if not clean:
        raise FormulaError("the formula is empty")
    if ";" in _LITERAL.sub("", clean) or "--" in _LITERAL.sub("", clean) or "/*" in clean:
        raise FormulaError(f"statements and comments are not allowed in a formula: {clean!r}")
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(_rewrite_powers(clean))
    except FormulaError:
        raise
    except Exception as error:
        raise FormulaError(f"formula does not parse: {clean!r}") from error
    return _Builder(names, clean, aggregates).build(tree)


def formula_sql(df: DataFrame, text: str) -> str:
    """The formula as SQL text with the meaning it has here, whatever dialect reads like it."""
    spark = session_of(df)
    bare = spark.createDataFrame([], df.schema)  # columns without the qualifiers of their source
    tree = bare.select(formula_column(spark, text, df.columns).alias("x"))._jdf.queryExecution().analyzed()
    return tree.expressions().apply(0).child().sql()


def derive(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Add a column computed by a formula; the formula is type-checked against the table."""
    value = formula_column(session_of(df), formula, df.columns)
    try:
        return df.withColumn(name, value)
    except Exception as error:
        raise FormulaError(f"formula does not fit the table: {formula!r}") from error


def apply_metrics(
    df: DataFrame, metrics: dict[str, str], group: Sequence[str] = ()
) -> DataFrame:
    """User-named metrics: each formula is evaluated per row, then summed per group."""
    spark = session_of(df)
    named = {n: formula_column(spark, f, df.columns) for n, f in metrics.items()}
    rows = df.select(*[col(g) for g in group], *[c.alias(n) for n, c in named.items()])
    sums = [F.sum(col(n)).alias(n) for n in named]
    return rows.groupBy(*[col(g) for g in group]).agg(*sums)
