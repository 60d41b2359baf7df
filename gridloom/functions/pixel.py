"""Functions of one value, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the sigmoid is cut off, the targets of the two classes.
SIGMOID_LOW, SIGMOID_HIGH = -709.0, 37.0
TARGET_LOW, TARGET_HIGH = 0.1, 0.9


def r6(c: Column) -> Column:
    """Rounded to six places, without negative zeros: how results are compared."""
    return F.round(c, 6) + F.lit(0.0)


def im2double(c: Column, dtype: str) -> Column:
    """Whole numbers over their type's range as 0 to 1."""
    bits = int(dtype[1:])
    if dtype[0] == "u":
        return c.cast("double") / float(2**bits - 1)
    if dtype[0] == "i":
        return (c.cast("double") + float(2 ** (bits - 1))) / float(2**bits - 1)
    if dtype[0] in "fb":
        return c.cast("double")
    raise ValueError(dtype)


def output_cast(c: Column, dtype: str) -> Column:
    top = {"u8": 255.0, "u16": 65535.0, "u32": 4294967295.0}.get(dtype)
    if top:
        return F.bround(c * top).cast("long")
    return c.cast({"f32": "float", "f64": "double"}[dtype])


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round_u8_steps(c: Column) -> Column:
    return F.bround(clip(c, 0.0, 1.0) * 255.0) / 255.0


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(c, SIGMOID_LOW, SIGMOID_HIGH)))


def hypot(x: Column, y: Column, precise: bool = False) -> Column:
    return F.hypot(x, y) if precise else F.sqrt(x * x + y * y)


def one_over(c: Column) -> Column:
    return 1.0 / F.when(c == 0, 1.0).otherwise(c)


def nan_to_num(c: Column) -> Column:
    most = 1.7976931348623157e308
    return F.when(F.isnan(c), 0.0).when(c == float("inf"), most).when(c == float("-inf"), -most).otherwise(c)


def target(label: Column) -> Column:
    return F.when(label, TARGET_HIGH).otherwise(TARGET_LOW)


def inverted(c: Column) -> Column:
    return 1.0 - c


def remap(i: Column, n: Column, mode: str) -> Column:
    """The index within 0 to n - 1 that a border mode reads for i."""
    if mode == "edge":
        return F.greatest(F.lit(0), F.least(i, n - 1))
    if mode == "symmetric":
        p = F.pmod(i, 2 * n)
        return F.least(p, 2 * n - 1 - p)
    if mode == "reflect":
        p = F.pmod(i, F.greatest(2 * n - 2, F.lit(1)))
        return F.when(n == 1, F.lit(0)).otherwise(F.least(p, 2 * n - 2 - p))
    raise ValueError(mode)
