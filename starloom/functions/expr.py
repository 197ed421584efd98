"""Expressions over catalogue columns, as text, to Spark columns: scores (numbers) and filters (booleans).

Names are exact and case-sensitive. Numbers follow IEEE rules where Spark's differ: NaN equals nothing, and no comparison
with it but != holds. A null boolean counts as false. Grammar: ``c ? a : b``, ``|| && !``, comparisons, ``+ - * / %``, ``^`` for
powers, functions of FUNCTIONS, ``cavg(a, b, ...)``: the mean of the finite arguments.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z_0-9.]*)|`([^`]+)`|(\|\||&&|==|!=|<=|>=|[-+*/%^<>!?:(),]))")

FUNCTIONS = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "ln": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin,
    "acos": F.acos, "atan": F.atan, "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"), "round": lambda c: F.round(c),
    "radians": F.radians, "degrees": F.degrees,
}
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class ExpressionError(ValueError):
    """The expression cannot be read, or is not of the kind asked for."""


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _average(*args: Column) -> Column:
    kept = F.filter(F.array(*args), _finite)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)).otherwise(F.lit(float("nan")))


class _Parser:
    def __init__(self, text: str, schema: T.StructType):
        text = text.strip()
        if len(text) >= 2 and text[0] == text[-1] == '"':
            text = text[1:-1]
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"cannot read '{text[at:]}'")
            kind = "number" if m[1] else "name" if m[2] or m[3] else "sign"
            self.tokens.append((kind, m[1] or m[2] or m[3] or m[4]))
            at = m.end()
        self.at, self.fields = 0, {f.name: f.dataType for f in schema}

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" else None

    def take(self, sign: str) -> None:
        if self.peek() != sign:
            raise ExpressionError(f"'{sign}' is expected")
        self.at += 1

    def all(self) -> tuple[Column, bool]:
        out = self.choice()
        if self.at != len(self.tokens):
            raise ExpressionError(f"unexpected '{self.tokens[self.at][1]}'")
        return out

    def choice(self):
        test, is_bool = self.level(0)
        if self.peek() != "?":
            return test, is_bool
        self.at += 1
        a, a_bool = self.choice()
        self.take(":")
        b, b_bool = self.choice()
        if not is_bool or a_bool != b_bool:
            raise ExpressionError("?: needs a boolean and two values of one kind")
        return F.when(test, a).otherwise(b), a_bool

    LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.unary()
        left, kind = self.level(k + 1)
        while self.peek() in self.LEVELS[k]:
            sign = self.peek()
            self.at += 1
            right, other = self.level(k + 1)
            left, kind = self.combine(sign, left, kind, right, other)
        return left, kind

    def combine(self, sign, a, a_bool, b, b_bool):
        if a_bool != b_bool or (sign in ("||", "&&")) != a_bool and not (a_bool and sign in ("==", "!=")):
            raise ExpressionError(f"'{sign}' does not fit its operands")
        if sign in ("||", "&&"):
            return (a | b if sign == "||" else a & b), True
        if sign in ("==", "!=", "<", "<=", ">", ">="):
            plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]
            if a_bool:
                return plain, True
            odd = F.isnan(a) | F.isnan(b)
            return F.coalesce(odd | plain if sign == "!=" else ~odd & plain, F.lit(sign == "!=")), True
        inf = F.lit(float("inf"))
        ieee = F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.when(a > 0, inf).otherwise(-inf))
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: ieee, "%": lambda: F.when(b != 0, a % F.nullif(b, F.lit(0.0))).otherwise(F.lit(float("nan")))}[sign](), False

    def unary(self):
        if self.peek() in ("-", "+", "!"):
            sign = self.peek()
            self.at += 1
            value, is_bool = self.unary()
            if (sign == "!") != is_bool:
                raise ExpressionError(f"'{sign}' does not fit its operand")
            return (~value if sign == "!" else -value if sign == "-" else value), is_bool
        base, is_bool = self.atom()
        if self.peek() == "^":
            self.at += 1
            power, other = self.unary()
            if is_bool or other:
                raise ExpressionError("'^' needs numbers")
            return F.pow(base, power), False
        return base, is_bool

    def atom(self):
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(text)), False
        if text == "(":
            out = self.choice()
            self.take(")")
            return out
        if kind == "sign":
            raise ExpressionError(f"unexpected '{text}'")
        if self.peek() == "(":
            self.at += 1
            args = []
            while self.peek() != ")":
                args.append(self.choice())
                if self.peek() == ",":
                    self.at += 1
            self.at += 1
            if any(b for _, b in args):
                raise ExpressionError(f"{text} takes numbers")
            values = [a for a, _ in args]
            if text == "cavg" and values:
                return _average(*values), False
            if text in ("min", "max") and values:
                return reduce(lambda x, y: F.when((x <= y) if text == "min" else (x >= y), x).otherwise(y), values), False
            if text == "pow" and len(values) == 2:
                return F.pow(*values), False
            if text == "isnan" and len(values) == 1:
                return F.isnan(values[0]), True
            if text in FUNCTIONS and len(values) == 1:
                return FUNCTIONS[text](values[0]), False
            raise ExpressionError(f"no function {text} of {len(values)} arguments")
        if text in ("true", "false"):
            return F.lit(text == "true"), True
        if text not in self.fields:
            raise ExpressionError(f"no column named {text}")
        column, data_type = F.col(f"`{text}`"), self.fields[text]
        if isinstance(data_type, T.BooleanType):
            return F.coalesce(column, F.lit(False)), True
        if not isinstance(data_type, _NUMBERS):
            raise ExpressionError(f"column {text} is neither a number nor a boolean")
        # a missing number is NaN, as in the files
        return F.coalesce(column.cast("double"), F.lit(float("nan"))), False


def number(df: DataFrame, text: str) -> Column:
    """A column of doubles; ExpressionError if the expression is a boolean."""
    out, is_bool = _Parser(text, df.schema).all()
    if is_bool:
        raise ExpressionError("a number is expected")
    return out


def boolean(df: DataFrame, text: str) -> Column:
    """A column of booleans; ExpressionError if the expression is a number."""
    out, is_bool = _Parser(text, df.schema).all()
    if not is_bool:
        raise ExpressionError("a boolean is expected")
    return out
