"""Scalars: lexical form to value (Python, in the binder) and value to lexical form (Columns, in the marshaller)."""

from __future__ import annotations

import base64
import datetime as dt
import math
import re
from collections.abc import Callable
from decimal import Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What values are trimmed of: all characters up to the blank.
TRIMMED = "".join(map(chr, range(33)))
#: A qualified name as a value: its namespace (empty for none), local part and prefix.
QNAME = T.StructType([T.StructField("ns", T.StringType()), T.StructField("local", T.StringType()), T.StructField("prefix", T.StringType())])
_CONTEXT = Context(prec=80)
_INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _integer(bits: int) -> Callable[[str], int]:
    def parse(x: str) -> int:
        if not re.fullmatch(r"[+-]?[0-9]{1,4000}", x) or not -(1 << bits - 1) <= (n := int(x)) < 1 << bits - 1:
            raise ValueError(f"not a {bits}-bit integer: {x}")
        return n

    return parse


_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,9})?"


def _decimal(kind: T.DecimalType) -> Callable[[str], Decimal]:
    def parse(x: str) -> Decimal:
        if not re.fullmatch(_DECIMAL, x):
            raise ValueError(f"not a decimal: {x[:80]}")
        value = Decimal(x)
        _, digits, exponent = value.as_tuple()
        significant = len(digits) - next((i for i, d in enumerate(digits) if d), len(digits))
        trailing = next((i for i, d in enumerate(reversed(digits)) if d), 0)
        if any(digits) and (-exponent - trailing > kind.scale or significant + exponent > kind.precision - kind.scale):
            raise ValueError(f"not a decimal({kind.precision},{kind.scale}): {x[:80]}")
        return value.quantize(Decimal(1).scaleb(-kind.scale), context=_CONTEXT) if any(digits) else Decimal(0)

    return parse


def _any_decimal(x: str) -> str:
    """A decimal of any size, as text."""
    if not re.fullmatch(_DECIMAL, x):
        raise ValueError(f"not a decimal: {x[:80]}")
    return x


def qname(x: str, scope: dict[str, str]) -> dict[str, str]:
    """A qualified name by the namespaces in scope."""
    prefix, colon, local = x.strip(TRIMMED).partition(":")
    if not colon:
        prefix, local = "", prefix
    if prefix and prefix not in scope:
        raise ValueError(f"Unbound prefix in {x.strip(TRIMMED)}")
    return {"ns": scope.get(prefix, ""), "local": local, "prefix": prefix}


def _double(x: str) -> float:
    special = {"INF": math.inf, "-INF": -math.inf, "NaN": math.nan}
    if x in special:
        return special[x]
    if not re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", x):
        raise ValueError(f"not a number: {x}")
    return float(x)


def _boolean(x: str) -> bool:
    if x not in ("true", "1", "false", "0"):
        raise ValueError(f"not a boolean: {x}")
    return x in ("true", "1")


def _instant(x: str) -> dt.datetime:
    value = dt.datetime.fromisoformat(x)
    if value.tzinfo is None:
        raise ValueError(f"an instant needs a zone: {x}")
    return value


def parser(kind: T.DataType, meta: dict) -> Callable[[str], object]:
    """How a field's lexical form is read; all but strings are trimmed. A string field marked ``decimal`` holds a decimal of
    any size; a structure marked ``qname`` is read with the namespaces in scope, which its reader gets as well."""
    if meta.get("qname"):
        if kind != QNAME:
            raise TypeError("a qualified name is a structure of ns, local and prefix")
        return qname
    if isinstance(kind, T.StringType) and meta.get("decimal"):
        return lambda x: _any_decimal(x.strip(TRIMMED))
    if isinstance(kind, T.StringType):
        if values := meta.get("enum"):
            back = {v: k for k, v in values.items()}

            def enum(x: str) -> str:
                if (x := x.strip(TRIMMED)) not in back:
                    raise ValueError(f"unknown value: {x}")
                return back[x]

            return enum
        return lambda x: x
    if isinstance(kind, T.DecimalType):
        read: Callable[[str], object] = _decimal(kind)
    elif isinstance(kind, T.BinaryType):
        read = bytes.fromhex if meta.get("hex") else lambda x: base64.b64decode(re.sub(r"\s", "", x), validate=True)
    else:
        reads = {T.DoubleType: _double, T.FloatType: _double, T.BooleanType: _boolean, T.DateType: dt.date.fromisoformat, T.TimestampNTZType: dt.datetime.fromisoformat, T.TimestampType: _instant} | {k: _integer(b) for k, b in _INTEGERS.items()}
        if type(kind) not in reads:
            raise TypeError(f"unsupported scalar type {kind.simpleString()}")
        read = reads[type(kind)]

    def trimmed(x: str) -> object:
        try:
            return read(x.strip(TRIMMED))
        except (ValueError, ArithmeticError) as e:
            raise ValueError(str(e) or f"invalid {kind.simpleString()}: {x[:80]}") from None

    return trimmed


def lexical(value: Column, kind: T.DataType, meta: dict) -> Column:
    """A value's lexical form, not escaped; null stays null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        special = F.when(F.isnan(value), "NaN").when(value == float("inf"), "INF").when(value == float("-inf"), "-INF")
        return F.when(value.isNotNull(), special.otherwise(value.cast("string")))
    if isinstance(kind, T.BinaryType):
        return F.upper(F.hex(value)) if meta.get("hex") else F.base64(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(kind, T.StringType) and (values := meta.get("enum")):
        return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), value)
    return value.cast("string")


def escape_text(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_attribute(x: Column) -> Column:
    return F.replace(escape_text(x), F.lit('"'), F.lit("&quot;"))
