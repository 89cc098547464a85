"""The value kinds of property columns and conversions between them, as Column expressions."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConversionError(ValueError):
    """A value, or a kind, can't be converted."""


class Kind(Enum):
    """Value kinds: name, Spark type, bits of integers. The order is that of the type byte in binary files. Fixed values."""

    BOOL = ("bool", "smallint", 8)
    INT16 = ("int16_t", "smallint", 16)
    INT32 = ("int32_t", "int", 32)
    INT64 = ("int64_t", "bigint", 64)
    DOUBLE = ("double", "double", 0)
    LONG_DOUBLE = ("long double", "binary", 0)
    STRING = ("string", "string", 0)
    VECTOR_BOOL = ("vector<bool>", "array<smallint>", 0)
    VECTOR_INT16 = ("vector<int16_t>", "array<smallint>", 0)
    VECTOR_INT32 = ("vector<int32_t>", "array<int>", 0)
    VECTOR_INT64 = ("vector<int64_t>", "array<bigint>", 0)
    VECTOR_DOUBLE = ("vector<double>", "array<double>", 0)
    VECTOR_LONG_DOUBLE = ("vector<long double>", "array<binary>", 0)
    VECTOR_STRING = ("vector<string>", "array<string>", 0)
    OBJECT = ("python::object", "binary", 0)

    @property
    def label(self) -> str:
        return self.value[0]

    @property
    def spark(self) -> str:
        return self.value[1]

    @property
    def bits(self) -> int:
        return self.value[2]

    @property
    def is_integer(self) -> bool:
        return self.bits > 0

    @property
    def is_scalar(self) -> bool:
        return self.is_integer or self is Kind.DOUBLE

    @property
    def element(self) -> Kind | None:
        return Kind.of(self.label[7:-1]) if self.label.startswith("vector<") else None

    @classmethod
    def of(cls, name: str) -> Kind:
        for k in cls:
            if k.label == name:
                return k
        raise ConversionError(f"no kind is called {name}")


def convertible(source: Kind, target: Kind) -> bool:
    """Equal kinds, anything from and to objects, scalars and strings among themselves, and vectors of such."""
    if source is target or Kind.OBJECT in (source, target):
        return True
    if (a := source.element) and (b := target.element):
        return convertible(a, b)
    plain = lambda k: k.is_scalar or k is Kind.STRING
    return plain(source) and plain(target)


def wrap(x: Column, kind: Kind) -> Column:
    """A long, taken modulo 2 ** bits into the kind's range; bool is a byte from 0 to 255."""
    if kind is Kind.BOOL:
        return x.bitwiseAND(F.lit(255)).cast("smallint")
    if kind.bits == 64:
        return x.cast("bigint")
    lost = 64 - kind.bits
    return F.shiftright(F.shiftleft(x.cast("bigint"), lost), lost).cast(kind.spark)


def convert(x: Column, source: Kind, target: Kind) -> Column:
    """x, converted; null where a string is no such number.

    Integers wrap, doubles are cut off and held in range, NaN gives 0; strings must be numbers as a whole, without
    spaces or line breaks, and bytes are read as 32-bit numbers first; doubles print in the shortest way that reads back,
    without exponent. A vector with an element that can't be converted is null as a whole.
    """
    if not convertible(source, target):
        raise ConversionError(f"{source.label} can't be made {target.label}")
    if source is target:
        return x
    if source.element and target.element:
        made = F.transform(x, lambda y: convert(y, source.element, target.element))
        return F.when(~F.exists(made, lambda y: y.isNull()), made)
    if Kind.OBJECT in (source, target):
        raise ConversionError("objects are converted in Python only")
    if source is Kind.STRING:
        if target is Kind.DOUBLE:
            number = F.regexp_like(x, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"))
            low = F.lower(x)
            special = F.when(low.isin("nan", "+nan", "-nan"), F.lit(float("nan"))).when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
            return F.when(number, x.try_cast("double")).otherwise(special)
        strict = F.when(F.regexp_like(x, F.lit(r"^[+-]?[0-9]+\z")), x)
        return wrap(strict.try_cast("int"), target) if target is Kind.BOOL else strict.try_cast(target.spark)
    if target is Kind.STRING:
        if source is not Kind.DOUBLE:
            return x.cast("string")
        return plain_text(x)
    if target is Kind.DOUBLE:
        return x.cast("double")
    if source is Kind.DOUBLE:
        low, high = (0, 255) if target is Kind.BOOL else (-(1 << (target.bits - 1)), (1 << (target.bits - 1)) - 1)
        return F.when(F.isnan(x), F.lit(0)).when(x >= float(high), F.lit(high)).when(x <= float(low), F.lit(low)).otherwise(F.when((x < float(high)) & (x > float(low)), x).cast("bigint")).cast(target.spark)
    return wrap(x.cast("bigint"), target)


def plain_text(x: Column) -> Column:
    """A double in decimal digits without exponent: 1e20 is 1 and twenty zeros, 1e-5 0.00001, and minus zero -0."""
    size = F.abs(x)
    # the fewest digits of 15, 16 and 17 that read back; with zeros at their end, which go, any shorter form is one of 15
    short, longer = (F.format_string(f"%.{n}E", size) for n in (14, 15))
    text = F.when(short.cast("double") == size, short).when(longer.cast("double") == size, longer).otherwise(size.cast("string"))
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    mantissa, power = F.substring_index(text, "E", 1), F.coalesce(F.try_element_at(F.split(text, "E"), F.lit(2)).cast("int"), F.lit(0))
    before, after = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(before, after)
    point = F.length(before) + power  # digits before the point
    size = F.length(digits)
    number = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    return F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, F.concat(sign, F.lit("0"))).otherwise(F.concat(sign, number))


def copied(df: DataFrame, key: str, source: str, source_kind: Kind, target: str, target_kind: Kind) -> tuple[DataFrame, int | None]:
    """df with the converted source in column target, and the smallest key whose value can't be converted, or None.

    Every row is attempted; where that fails target stays as it is, or null if there was none.
    """
    made = convert(F.col(source), source_kind, target_kind)
    bad = F.col(source).isNotNull() & made.isNull()
    old = F.col(target) if target in df.columns else F.lit(None).cast(target_kind.spark)
    first = df.where(bad).agg(F.min(key)).first()[0]
    return df.withColumn(target, F.when(bad, old).otherwise(made)), first


def copy_prop(df: DataFrame, key: str, source: str, source_kind: Kind, target: str, target_kind: Kind) -> DataFrame:
    """df with the converted source in column target; a ConversionError names the smallest key that can't be converted."""
    out, first = copied(df, key, source, source_kind, target, target_kind)
    if first is not None:
        raise ConversionError(f"{key} {first}: {source_kind.label} can't be made {target_kind.label}")
    return out


class DynWrap:
    """A column read and written as another kind: values are converted on the way.

    read and write say which is allowed; the other raises a ConversionError. underlying gives the column's own kind.
    """

    def __init__(self, column: str, kind: Kind, as_kind: Kind, read: bool = True, write: bool = True):
        if read and not convertible(kind, as_kind) or write and not convertible(as_kind, kind):
            raise ConversionError(f"{kind.label} and {as_kind.label} can't be converted")
        self.column, self.underlying, self.as_kind, self.read, self.write = column, kind, as_kind, read, write

    def get(self) -> Column:
        if not self.read:
            raise ConversionError(f"{self.column} can't be read")
        return convert(F.col(self.column), self.underlying, self.as_kind)

    def put(self, df: DataFrame, value: Column, where: Column | None = None) -> DataFrame:
        """df with the column set to value, a column of as_kind, where the condition holds; values that can't be converted change nothing."""
        if not self.write:
            raise ConversionError(f"{self.column} can't be written")
        made = F.coalesce(convert(value, self.as_kind, self.underlying), F.col(self.column))
        return df.withColumn(self.column, made if where is None else F.when(where, made).otherwise(F.col(self.column)))
