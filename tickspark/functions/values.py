"""Null, NaN and truthiness helpers, plus number formatting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy_coalesce(*cols) -> Column:
    """``a or b or c`` with Python truthiness: null, 0, 0.0 and '' fall through
    to the next alternative. The last alternative is returned as is."""
    cols = [_col(c) for c in cols]
    parts = [F.when(is_truthy(c), c) for c in cols[:-1]]
    return F.coalesce(*parts, cols[-1])


def is_truthy(c) -> Column:
    """Python truthiness of a scalar: not null, not '' and not numerically 0."""
    c = _col(c)
    as_text = c.cast("string")
    return (c.isNotNull() & (as_text != F.lit(""))
            & (F.coalesce(as_text.try_cast("double"), F.lit(1.0)) != F.lit(0.0)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null on every double/float column (JSON has no NaN)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def wire_number(c) -> Column:
    """A number sent as a JSON number or as text; null where it is neither (or not finite). The cast also
    takes type suffixes, words and hexadecimal, which end in a letter or hold an x."""
    text = F.trim(_col(c).cast("string"))
    end = F.substring(text, -1, 1)
    value = text.try_cast("double")
    plain = (end.between("0", "9") | (end == ".")) & ~text.contains("x") & ~text.contains("X")
    return F.when(plain & (F.abs(value) < float("inf")), value)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it (keeps expressions small)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fmt_fixed(c, decimals: int) -> Column:
    """``f"{x:.2f}"``: the exact binary value of the double rounded half-even, as C and Python print it (2.675
    is below its decimal text, 0.125 a true tie).

    The fraction is k / 2**75 with a whole k (put together from two parts that doubles hold exactly; what
    lies below 2**-75 is far from a tie at the few decimals printed), so fraction * 10**decimals splits
    into a whole part and a remainder that is compared with one half in whole numbers. From 2**53 on
    doubles are whole; those print their shortest digits.
    """
    unit, half = F.lit(Decimal(1 << 75)).cast("decimal(38,0)"), F.lit(Decimal(1 << 74)).cast("decimal(38,0)")
    power = F.lit(10 ** decimals)

    def rounded(high: Column, size: Column) -> Column:
        """Fraction digits as a whole number, 10**decimals where they round up to one."""
        last = F.lit(0) if decimals else F.floor(size).cast("long")  # without decimals the whole part decides what is even
        k = (F.floor(high).cast("decimal(20,0)") * F.lit(1 << 22).cast("decimal(7,0)")
             + F.floor((high - F.floor(high)) * F.lit(float(1 << 22))).cast("decimal(7,0)"))
        shifted = (k * power.cast("decimal(10,0)")).cast("decimal(38,0)")
        # the remainder goes first: a quotient with a fraction would be rounded
        split = _bind(shifted, lambda n: F.struct((n % unit).alias("rest"), ((n - n % unit) / unit).cast("long").alias("digits")))
        return _bind(split, lambda p: p["digits"] + F.when(
            (p["rest"] > half) | ((p["rest"] == half) & ((p["digits"] + last) % 2 == 1)), 1).otherwise(0))

    def text(x: Column) -> Column:
        size = F.abs(x)
        digits = _bind((size - F.floor(size)) * F.lit(float(1 << 53)), lambda high: rounded(high, size))
        whole = lambda d: F.floor(size).cast("long") + F.floor(d / power).cast("long")
        number = _bind(digits, lambda d: F.concat(whole(d).cast("string"), F.lit("."), F.lpad((d % power).cast("string"), decimals, "0"))
                       if decimals else whole(d).cast("string"))
        sign = F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
        return (F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.concat(sign, F.lit("inf")))
                .when(size < float(1 << 53), F.concat(sign, number)).otherwise(F.format_string(f"%.{decimals}f", x)))

    # away from ties the JVM's own rounding is right, and the rest is not evaluated
    x = _col(c).cast("double")
    scaled = F.abs(x) * float(10 ** decimals)
    easy = (scaled < 1e11) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(easy, F.format_string(f"%.{decimals}f", x)).otherwise(_bind(x, lambda v: F.when(v.isNotNull(), text(v))))


def fmt_money(c, decimals: int = 2) -> Column:
    """``f"${x:.2f}"``."""
    return F.concat(F.lit("$"), fmt_fixed(c, decimals))


def py_float(c) -> Column:
    """``repr`` of a Python float: shortest digits, plain from 1e-4 to below 1e16 (``10000000.0``), else with
    an exponent of two digits (``1e+16``). JVMs before 19 print a few doubles with a digit more than
    needed; so does this."""
    def show(x: Column, text: Column) -> Column:
        plain = _bind(F.rtrim(text.try_cast("decimal(38,20)").cast("string"), F.lit("0")),
                      lambda p: F.when(p.endswith("."), F.concat(p, F.lit("0"))).otherwise(p))
        power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
        far = F.concat(F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", ""), F.lit("e"),
                       F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
        size = F.abs(x)
        return (F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
                .when(x == 0, text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(far))

    x = _col(c).cast("double")
    return (F.when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7), x.cast("string"))  # here both print alike
            .otherwise(_bind(x, lambda v: F.when(v.isNotNull(), _bind(v.cast("string"), lambda t: show(v, t))))))


def py_float_commas(c) -> Column:
    """``f"{x:,}"`` of a Python float: its ``repr`` with thousands separators in the whole part (``1,234.5``)."""
    def grouped(text: Column) -> Column:
        whole = F.split_part(text, F.lit("."), F.lit(1))
        return F.when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), F.concat(
            F.regexp_replace(whole, r"(?<=[0-9])(?=([0-9]{3})+$)", ","), F.lit("."), F.split_part(text, F.lit("."), F.lit(2)))).otherwise(text)

    return _bind(py_float(c), grouped)
