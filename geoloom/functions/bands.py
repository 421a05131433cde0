"""Band expressions: a small language over raster bands, compiled to Catalyst columns.

Bands are DOUBLE columns.  Truth is 1.0 or 0.0, anything but zero is true (NaN too), division by zero is NaN, and
comparisons with NaN are false except ``!=``.  No UDF is involved, so expressions fold and compile like any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_][A-Za-z_0-9]*)|(\|\||&&|>=|<=|==|!=|[-+*/^()<>,]))")
BAND = re.compile(r"b(?:and)?(\d+)$", re.IGNORECASE)
ONE = ("sqrt", "abs", "sin", "cos", "tan", "log", "ln", "log10", "exp", "floor", "ceil", "round")
TWO = ("min", "max", "pow")
MOST_BANDS = 32


class BandSyntaxError(ValueError):
    """The text isn't a band expression."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()
    value: float | int | None = None


def tokenize(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise BandSyntaxError(f"unexpected {text[at:].strip()[:1]!r} in {text!r}")
        out.append(m.group(m.lastindex))
        at = m.end()
    return out


class Parser:
    """Recursive descent, loosest first: ``||``, ``&&``, comparisons, sums, products, ``^`` (right), signs."""

    LEVELS = (("||",), ("&&",), (">", ">=", "<", "<=", "==", "!="), ("+", "-"), ("*", "/"))

    def __init__(self, text: str):
        self.tokens, self.at, self.text = tokenize(text), 0, text

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if token is None or expected is not None and token != expected:
            raise BandSyntaxError(f"expected {expected or 'more'} in {self.text!r}")
        self.at += 1
        return token

    def parse(self) -> Node:
        node = self.level(0)
        if self.peek() is not None:
            raise BandSyntaxError(f"unexpected {self.peek()!r} in {self.text!r}")
        if len(bands_of(node)) > MOST_BANDS:
            raise BandSyntaxError(f"more than {MOST_BANDS} bands in {self.text!r}")
        return node

    def level(self, n: int) -> Node:
        if n == len(self.LEVELS):
            return self.power()
        node = self.level(n + 1)
        while self.peek() in self.LEVELS[n]:
            node = Node(self.take(), (node, self.level(n + 1)))
        return node

    def power(self) -> Node:
        base = self.sign()
        if self.peek() == "^":
            self.take()
            return Node("pow", (base, self.power()))
        return base

    def sign(self) -> Node:
        if self.peek() in ("-", "+"):
            return Node("neg", (self.sign(),)) if self.take() == "-" else self.sign()
        return self.primary()

    def primary(self) -> Node:
        token = self.take()
        if token == "(":
            node = self.level(0)
            self.take(")")
            return node
        if token[0].isdigit() or token[0] == ".":
            return Node("number", value=float(token))
        if m := BAND.match(token):
            if int(m[1]) < 1:
                raise BandSyntaxError("bands count from 1")
            return Node("band", value=int(m[1]))
        name = token.lower()
        if name not in ONE + TWO:
            raise BandSyntaxError(f"unknown name {token!r} in {self.text!r}")
        self.take("(")
        args = [self.level(0)]
        while self.peek() == ",":
            self.take()
            args.append(self.level(0))
        self.take(")")
        if len(args) != 1 + (name in TWO):
            raise BandSyntaxError(f"{name} takes {1 + (name in TWO)} argument(s)")
        return Node("log" if name == "ln" else name, tuple(args))


def bands_of(node: Node) -> set[int]:
    return {node.value} if node.op == "band" else set().union(*map(bands_of, node.args)) if node.args else set()


def nan() -> Column:
    return F.lit(NAN)


def ratio(n: Column, d: Column) -> Column:
    """n / d, NaN where d is zero."""
    return F.when(d == 0.0, nan()).otherwise(n / F.when(d == 0.0, F.lit(1.0)).otherwise(d))


def _compare(op: str, a: Column, b: Column) -> Column:
    odd = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return F.when(odd | (a != b), 1.0).otherwise(0.0)
    hit = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b}[op]
    return F.when(~odd & hit, 1.0).otherwise(0.0)


def _log(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf"))).otherwise(nan())


def truth(x: Column) -> Column:
    """Not zero; NaN is true."""
    return F.isnan(x) | (x != 0.0)


def to_column(node: Node, bands: dict[int, Column]) -> Column:
    """Fold a syntax tree to a column."""
    a = [to_column(x, bands) for x in node.args]
    if node.op == "number":
        return F.lit(float(node.value))
    if node.op == "band":
        if node.value not in bands:
            raise ValueError(f"there is no band {node.value}")
        return bands[node.value].cast("double")
    if node.op in ("+", "-", "*"):
        return a[0] + a[1] if node.op == "+" else a[0] - a[1] if node.op == "-" else a[0] * a[1]
    if node.op == "/":
        return ratio(a[0], a[1])
    if node.op in ("&&", "||"):
        both = truth(a[0]) & truth(a[1]) if node.op == "&&" else truth(a[0]) | truth(a[1])
        return F.when(both, 1.0).otherwise(0.0)
    if node.op in (">", ">=", "<", "<=", "==", "!="):
        return _compare(node.op, a[0], a[1])
    if node.op == "min":
        return F.when(F.isnan(a[0]), a[1]).when(F.isnan(a[1]), a[0]).otherwise(F.least(a[0], a[1]))
    if node.op == "max":
        return F.when(F.isnan(a[0]), a[1]).when(F.isnan(a[1]), a[0]).otherwise(F.greatest(a[0], a[1]))
    if node.op == "neg":
        return -a[0]
    if node.op == "pow":
        return F.pow(a[0], a[1])
    if node.op == "log":
        return _log(a[0], F.ln)
    if node.op == "log10":
        return _log(a[0], F.log10)
    if node.op in ("floor", "ceil"):
        big = F.isnan(a[0]) | (F.abs(a[0]) >= 2.0**52)
        whole = (F.floor if node.op == "floor" else F.ceil)(F.when(big, 0.0).otherwise(a[0])).cast("double")
        return F.when(big, a[0]).otherwise(whole)
    if node.op == "round":
        big = F.isnan(a[0]) | (F.abs(a[0]) >= 2.0**52)
        away = F.signum(a[0]) * F.floor(F.when(big, 0.0).otherwise(F.abs(a[0])) + 0.5)
        return F.when(big, a[0]).otherwise(away.cast("double"))
    return {"sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp}[node.op](a[0])


def compile_expression(text: str, bands: dict[int, Column]) -> Column:
    """The column of a band expression; only the bands it names are touched, so scans stay pruned."""
    return to_column(Parser(text).parse(), bands)


def is_valid_expression(text: str) -> bool:
    try:
        Parser(text).parse()
    except BandSyntaxError:
        return False
    return True


def calculate(text: str, bands: dict[int, Column], condition: str | None = None, nodata: float = -9999.0) -> Column:
    """An expression with ``nodata`` where the condition is zero or NaN; an empty condition is none."""
    value = compile_expression(text, bands)
    if not condition or not condition.strip():
        return value
    c = compile_expression(condition, bands)
    return F.when(~F.isnan(c) & (c != 0.0), value).otherwise(F.lit(float(nodata)))


def calculate_batch(expressions: list[str], bands: dict[int, Column]) -> tuple[dict[str, Column], dict[str, str]]:
    """Columns of the expressions that compile, and the errors of those that don't."""
    columns, errors = {}, {}
    for text in expressions:
        try:
            columns[text] = compile_expression(text, bands)
        except ValueError as e:
            errors[text] = str(e)
    return columns, errors


@dataclass(frozen=True)
class Rule:
    """Values from ``low`` to ``high`` become ``value``; each end is in the range or not."""

    low: float
    high: float
    value: float
    with_low: bool = True
    with_high: bool = False


def _within(v: Column, r: Rule) -> Column:
    return (v >= r.low if r.with_low else v > r.low) & (v <= r.high if r.with_high else v < r.high) & ~F.isnan(v)


def conditional_replace(v: Column, rules: list[Rule]) -> Column:
    """The first rule that holds; other values stay."""
    out = None
    for r in rules:
        out = F.when(_within(v, r), F.lit(float(r.value))) if out is None else out.when(_within(v, r), F.lit(float(r.value)))
    return v if out is None else out.otherwise(v)


def reclassify(v: Column, rules: list[Rule], default: float) -> Column:
    """Ranges [low, high), first match, else ``default``; NaN passes through."""
    out = F.when(F.isnan(v), v)
    for r in rules:
        out = out.when((v >= r.low) & (v < r.high), F.lit(float(r.value)))
    return out.otherwise(F.lit(float(default)))


def band_math(a: Column, b: Column, op: str) -> Column:
    """add, sub, mul, div (zero gives NaN), min, max (NaN wins), pow."""
    if op in ("min", "max"):
        pick = F.least(a, b) if op == "min" else F.greatest(a, b)
        return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(pick)
    return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: ratio(a, b), "pow": lambda: F.pow(a, b)}[op]()


def band_scalar(a: Column, x: float, op: str) -> Column:
    """As :func:`band_math` with a number; min and max leave the band as it is."""
    return a if op in ("min", "max") else band_math(a, F.lit(float(x)), op)


def mask(v: Column, keep: Column, nodata: float) -> Column:
    return F.when(keep, v).otherwise(F.lit(float(nodata)))


def nodata_mask(v: Column, nodata: float | None) -> Column:
    """True where a value is data."""
    return ~F.isnan(v) & (F.lit(True) if nodata is None else v != F.lit(float(nodata)))


def threshold_mask(v: Column, low: float, high: float) -> Column:
    """True from ``low`` to ``high``, both included."""
    return ~F.isnan(v) & (v >= low) & (v <= high)


# --- indices -------------------------------------------------------------------------------------------------


def normalized_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def mndwi(green: Column, swir: Column) -> Column:
    return normalized_difference(green, swir)


def ndbi(swir: Column, nir: Column) -> Column:
    return normalized_difference(swir, nir)


def ndsi(green: Column, swir: Column) -> Column:
    return normalized_difference(green, swir)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return ratio(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    k = round(float(soil), 6)
    return ratio(nir - red, nir + red + k) * (1.0 + k)


def lai(nir: Column, red: Column, nan_is_dense: bool = True) -> Column:
    """Leaf area from NDVI: 6 from 0.69 on, 0 up to 0.1; a NaN index counts as dense unless told otherwise."""
    v = ndvi(nir, red)
    low = F.when(v <= 0.1, 0.0).otherwise(-F.ln((0.69 - F.when((v > 0.1) & (v < 0.69), v).otherwise(0.1)) / 0.59) / 0.91)
    return F.when(F.isnan(v), F.lit(6.0 if nan_is_dense else NAN)).when(v >= 0.69, 6.0).otherwise(low)


#: The least and greatest number of each whole band type.
RANGES = {
    "Byte": (0, 255), "Int8": (-128, 127), "UInt16": (0, 65535), "Int16": (-32768, 32767), "UInt32": (0, 4294967295), "Int32": (-2147483648, 2147483647),
}


def to_band_type(v: Column, kind: str, nodata: float | None = None) -> Column:
    """A value as a band of a type stores it: whole types round half away from zero and hold to their range, Float32
    rounds to single precision, Float64 keeps it.  NaN and null are ``nodata`` (0 where there is none) in whole types."""
    if kind in RANGES:
        low, high = RANGES[kind]
        rounded = F.signum(v) * F.floor(F.abs(v) + 0.5)
        held = F.least(F.greatest(rounded, F.lit(float(low))), F.lit(float(high)))
        empty = F.lit(float(nodata or 0))
        return F.when(v.isNull() | F.isnan(v), empty).otherwise(held)
    if kind not in ("Float32", "Float64"):
        raise ValueError(f"unknown band type {kind}")
    return v.cast("float").cast("double") if kind == "Float32" else v


def calculate_and_write(pixels: DataFrame, text: str, target: int, kinds: dict[int, str], condition: str | None = None, nodata: float = -9999.0) -> DataFrame:
    """Wide pixels ``b1, b2 ...`` with band ``target`` set to an expression's values in that band's type.

    ``kinds`` names the type of each band there is; a target that isn't among them is refused.
    """
    if target not in kinds:
        raise ValueError(f"invalid target band {target}: there are {sorted(kinds)}")
    value = calculate(text, {n: F.col(f"b{n}").cast("double") for n in kinds}, condition, nodata)
    return pixels.withColumn(f"b{target}", to_band_type(value, kinds[target], nodata))
