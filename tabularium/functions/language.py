"""A small language for machine-proposed features, instead of running proposed code.

A program is a list of lines ``name = expression``; ``drop name`` removes a column. Expressions are parsed as Python
syntax but only these forms are understood: column names, numbers, strings, + - * / and unary minus, comparisons,
``and``/``or``/``not``, and calls of the registered operators. Anything else is a ``ProgramError``; nothing is executed.
"""

from __future__ import annotations

import ast
import copy
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import aggregates
from .ordered import running_sum


class ProgramError(ValueError):
    """A program that isn't in the language, or names what isn't there."""


def _aggregate(make: Callable) -> Callable:
    """A group aggregate given back to each row by a join; rows without a key get null."""

    def run(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
        table = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(make(F.col(value)).alias(name))
        return df.join(table, F.col(key) == F.col("_key"), "left").drop("_key")

    return run


def _aggregate_by_values(primitive: str) -> Callable:
    """The same of an aggregate that needs a group's distinct values."""

    def run(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
        table = aggregates(df.where(F.col(key).isNotNull()), key, [(name, primitive, value)]).withColumnRenamed(key, "_key")
        return df.join(table, F.col(key) == F.col("_key"), "left").drop("_key")

    return run


def group_rank(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """Average rank of the value in its group, from a row a distinct value."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranked = running_sum(counts, "_value", F.col("_n"), "_upto", ("_key",)).select("_key", "_value", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranked, (F.col(key) == F.col("_key")) & (F.col(value) == F.col("_value")), "left").drop("_key", "_value")


def frequency(df: DataFrame, name: str, column: str) -> DataFrame:
    """Share of the rows that have this value."""
    counts = df.groupBy(F.col(column).alias("_key")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    shares = counts.where("_key IS NOT NULL").crossJoin(F.broadcast(total)).select("_key", (F.col("_n") / F.col("_all")).alias(name))  # one row
    return df.join(shares, F.col(column) == F.col("_key"), "left").drop("_key")


def _both(f: Callable) -> Callable:
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), f(a, b))


def combine(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("_", a.cast("string"), b.cast("string")))


OPERATORS: dict[str, Callable[..., Column]] = {
    "absolute": F.abs,
    "logarithm": lambda c: F.when(c > 0, F.ln(c)),
    "square_root": lambda c: F.when(c >= 0, F.sqrt(c)),
    "sigmoid": lambda c: 1 / (1 + F.exp(-c)),
    "square": lambda c: c * c,
    "round": lambda c, n=None: F.bround(c, 0 if n is None else n),
    "residual": lambda c: c - F.floor(c),
    "minimum": _both(F.least),
    "maximum": _both(F.greatest),
    "combine": combine,
    "fillna": lambda c, v: F.coalesce(c, v),
    "replace": lambda c, old, new: F.when(c == old, new).otherwise(c),
    "to_number": lambda c: c.try_cast("double"),
    "to_text": lambda c: c.cast("string"),
    "to_integer": lambda c: c.try_cast("double").try_cast("bigint"),
    "contains": lambda c, s: c.contains(s),
    "extract": lambda c, p: F.nullif(F.call_function("regexp_extract", c, p, F.lit(1)), F.lit("")),
    "length": F.char_length,
    "bucket": lambda c, lo, hi, n: F.width_bucket(c.cast("double"), lo.cast("double"), hi.cast("double"), n.cast("int")),
    "is_null": lambda c: c.isNull(),
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
}


#: Operators over other rows: (table, name of the result, names of the columns) to the table with the result. They are declared
#: as an aggregate and a join, so a hot group isn't one task's, and no window holds the whole table.
TABLE_OPERATORS: dict[str, tuple[int, Callable[..., DataFrame]]] = {
    "frequency": (1, frequency),
    "group_min": (2, _aggregate(F.min)),
    "group_max": (2, _aggregate(F.max)),
    "group_mean": (2, _aggregate(F.avg)),
    "group_median": (2, _aggregate_by_values("median")),
    "group_std": (2, _aggregate(F.stddev_samp)),
    "group_nunique": (2, _aggregate_by_values("num_unique")),
    "group_rank": (2, group_rank),
}


def register_operator(name: str, make: Callable[..., Column]) -> None:
    """Add an operator: columns in, a column out."""
    if not name.isidentifier():
        raise ProgramError(f"not a name: {name}")
    OPERATORS[name] = make


class _Tables(ast.NodeTransformer):
    """Replaces calls of operators over other rows by names of columns, which it adds to the table, innermost first."""

    def __init__(self, df: DataFrame, known: set[str]):
        self.df, self.known, self.made = df, known, []

    def _add(self, column: Column) -> str:
        name = f"_part{len(self.made)}"
        while name in self.df.columns:
            name += "_"
        self.made.append(name)
        self.df = self.df.withColumn(name, column)
        return name

    def visit_Call(self, node: ast.Call) -> ast.AST:
        self.generic_visit(node)
        called = node.func.id if isinstance(node.func, ast.Name) else ""
        args = node.args
        if called == "combine_frequency" and len(args) == 2:
            called, args = "frequency", [ast.Call(ast.Name("combine"), args, [])]
        if called not in TABLE_OPERATORS:
            return node
        count, make = TABLE_OPERATORS[called]
        if len(args) != count or node.keywords:
            raise ProgramError(f"{called} takes {count} columns")
        names = [self._add(_column(a, self.known | {*self.made})) for a in args]
        name = f"_part{len(self.made)}_result"
        self.df = make(self.df, name, *names)
        self.made.append(name)
        return ast.Name(name)


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: lambda a, b: F.try_mod(a, b)}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def _column(node: ast.AST, known: set[str]) -> Column:
    if isinstance(node, ast.Name):
        if node.id not in known:
            raise ProgramError(f"no column {node.id}")
        return F.col(f"`{node.id}`")
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
        return F.lit(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_column(node.operand, known)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_column(node.operand, known)
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return _BINARY[type(node.op)](_column(node.left, known), _column(node.right, known))
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
        return _COMPARE[type(node.ops[0])](_column(node.left, known), _column(node.comparators[0], known))
    if isinstance(node, ast.BoolOp):
        parts = [_column(v, known) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        if node.func.id == "column" and len(node.args) == 1 and isinstance(node.args[0], ast.Constant):  # names that aren't identifiers
            if node.args[0].value not in known:
                raise ProgramError(f"no column {node.args[0].value}")
            return F.col(f"`{node.args[0].value}`")
        if node.func.id not in OPERATORS:
            raise ProgramError(f"no operator {node.func.id}")
        try:
            return OPERATORS[node.func.id](*[_column(a, known) for a in node.args])
        except TypeError as e:
            raise ProgramError(str(e)) from e
    raise ProgramError(f"not in the language: {ast.dump(node)[:80]}")


def parse(text: str) -> list[tuple[str, ast.AST | None]]:
    """(name, expression) by line; no expression where the column is dropped. Blank lines and comments are skipped."""
    out: list[tuple[str, ast.AST | None]] = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("drop "):
            out.append((line[5:].split("#", 1)[0].strip(), None))
            continue
        try:
            tree = ast.parse(line, mode="exec").body
        except SyntaxError as e:
            raise ProgramError(f"{line!r}: {e.msg}") from e
        if len(tree) != 1 or not isinstance(tree[0], ast.Assign) or len(tree[0].targets) != 1 or not isinstance(tree[0].targets[0], ast.Name):
            raise ProgramError(f"not an assignment: {line!r}")
        out.append((tree[0].targets[0].id, tree[0].value))
    return out


def apply(df: DataFrame, text: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a program's columns; the protected ones (target, key) can't be changed."""
    for name, tree in parse(text):
        if name in protected:
            raise ProgramError(f"{name} can't be changed")
        if tree is None:
            if name not in df.columns:
                raise ProgramError(f"no column {name}")
            df = df.drop(name)
        else:
            known = {*df.columns} - {*protected}
            tables = _Tables(df, known)
            tree = tables.visit(copy.deepcopy(tree))
            df = tables.df.withColumn(name, _column(tree, known | {*tables.made})).drop(*[c for c in tables.made if c != name])
    return df


def operations(text: str, columns: list[str]) -> dict[str, list[str]]:
    """What a program does to a table's columns: created, transformed, dropped, and the sources it reads."""
    made, changed, dropped, used = [], [], [], []
    for name, tree in parse(text):
        if tree is None:
            dropped.append(name)
            continue
        (changed if name in columns else made).append(name)
        used += [n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id in columns]
    return {"created": made, "transformed": changed, "dropped": dropped, "sources": list(dict.fromkeys(used))}


def signature(text: str) -> str:
    """The same for programs that differ in spelling only."""
    return hashlib.sha256("\n".join(f"{n}={ast.dump(t) if t is not None else 'drop'}" for n, t in parse(text)).encode()).hexdigest()[:16]
