"""Read-only scripts: a small expression language compiled to columns, never evaluated in Python."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+)|(\d+)[lL]?|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|&&|\|\||[-+*/%<>!?:().,\[\];]))")
_MATH: dict[str, Callable[..., Column]] = {"abs": F.abs, "sqrt": F.sqrt, "log": F.log, "log10": F.log10, "exp": F.exp, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "pow": F.pow, "max": F.greatest, "min": F.least, "sin": F.sin, "cos": F.cos, "tan": F.tan, "round": lambda x: F.floor(x + 0.5), "signum": F.signum}


class Script:
    """A parser by precedence. Values carry whether they are whole numbers, as whole numbers divide without a fraction."""

    def __init__(self, source: str, field: Callable[[str], Column], params: dict | None = None, score: Column | None = None, whole: Callable[[str], bool] = lambda _: False) -> None:
        self.tokens, at = [], 0
        source = source.strip().removeprefix("return ").rstrip("; \n")
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                if source[at:].strip():
                    raise ValueError(f"unexpected character in script at {at}: {source[at:at + 10]}")
                break
            self.tokens.append(next((kind, v) for kind, v in zip(("float", "int", "str", "name", "op"), m.groups(), strict=True) if v is not None))
            at = m.end()
        self.i, self.field, self.params, self.score, self.whole = 0, field, params or {}, score, whole

    def compile(self) -> Column:
        out, _ = self._ternary()
        if self.i != len(self.tokens):
            raise ValueError(f"unexpected token in script: {self.tokens[self.i][1]}")
        return out

    def _peek(self) -> str:
        return self.tokens[self.i][1] if self.i < len(self.tokens) and self.tokens[self.i][0] in ("op", "name") else ""

    def _take(self, want: str | None = None) -> str:
        if self.i >= len(self.tokens) or want is not None and self.tokens[self.i][1] != want:
            raise ValueError(f"expected [{want}] in script")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def _ternary(self) -> tuple[Column, bool]:
        c, w = self._binary(0)
        if self._peek() == "?":
            self._take()
            a, wa = self._ternary()
            self._take(":")
            b, wb = self._ternary()
            return F.when(c, a).otherwise(b), wa and wb
        return c, w

    _LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))

    def _binary(self, level: int) -> tuple[Column, bool]:
        if level == len(self._LEVELS):
            return self._unary()
        a, wa = self._binary(level + 1)
        while self._peek() in self._LEVELS[level]:
            op = self._take()
            b, wb = self._binary(level + 1)
            if op == "/" and wa and wb:
                a = F.call_function("div", a, b)
            else:
                a = {"||": lambda: a | b, "&&": lambda: a & b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[op]()
            wa = wa and wb and level > 3
        return a, wa

    def _unary(self) -> tuple[Column, bool]:
        if self._peek() in ("!", "-"):
            op = self._take()
            x, w = self._unary()
            return (~x, False) if op == "!" else (-x, w)
        return self._primary()

    def _primary(self) -> tuple[Column, bool]:
        kind, v = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
        self.i += 1
        if kind == "float":
            return F.lit(float(v)), False
        if kind == "int":
            return F.lit(int(v)), True
        if kind == "str":
            return F.lit(v[1:-1]), False
        if v == "(":
            out = self._ternary()
            self._take(")")
            return out
        if v in ("true", "false", "null"):
            return F.lit({"true": True, "false": False, "null": None}[v]), False
        if v == "_score":
            return self.score if self.score is not None else F.lit(1.0), False
        if v == "params":
            p = self._name_after()
            value = self.params[p]
            return F.lit(value), isinstance(value, int) and not isinstance(value, bool)
        if v == "Math":
            f = _MATH[self._name_after()]
            return f(*[a for a, _ in self._arguments()]), False
        if v == "doc":
            name = self._name_after()
            self._take(".")
            what = self._take()
            if self._peek() == "(":
                self._arguments()
            c = self.field(name)
            if what in ("size", "length"):
                return c.isNotNull().cast("int"), True
            if what == "empty":
                return c.isNull(), False
            return c, self.whole(name)
        return self.field(v), self.whole(v)  # a variable of buckets_path

    def _name_after(self) -> str:
        if self._peek() == "[":
            self._take()
            name = self._take()[1:-1]
            self._take("]")
            return name
        self._take(".")
        return self._take()

    def _arguments(self) -> list[tuple[Column, bool]]:
        self._take("(")
        out = []
        while self._peek() != ")":
            out.append(self._ternary())
            if self._peek() == ",":
                self._take()
        self._take(")")
        return out
