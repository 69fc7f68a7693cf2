"""Scalar functions: canonical texts, digests, typed values, keys."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between the fields of a canonical text.
UNIT = "\x1f"
#: Stands for null.
EMPTY = "\x1e"


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def canonical_decimal(x: Column) -> Column:
    """A number as plain decimal text: the shortest digits that read back as the number, without exponent or trailing
    zeros; ``-0`` is ``0``; null if not finite. Digits are moved as text, so the text is exact at any size.
    """
    text = F.when(finite(x), x.cast("string"))

    def given(s: Column) -> Column:
        # large numbers are whole, and taken with all their digits
        large = (s["size"] >= 1e16) & (s["size"] < 9.2e18)
        mantissa = F.substring_index(s["text"], "E", 1)
        digits = F.when(large, s["size"].cast("bigint").cast("string")).otherwise(F.replace(mantissa, F.lit("."), F.lit("")))
        power = F.when(large, 0).otherwise(F.substring_index(s["text"], "E", -1).try_cast("int") - F.length(mantissa) + 2)
        return F.struct(s["size"].alias("size"), digits.alias("digits"), power.alias("power"))

    def shown(s: Column) -> Column:
        # of digits that read back as the number the fewest count; the platform may show some more
        out = F
        for k in range(4, 0, -1):
            more = (s["digits"].cast("bigint") + 10**k // 2).cast("string")
            rounded = F.substring(more, F.lit(1), F.length(more) - k)
            same = F.concat(rounded, F.lit("E"), (s["power"] + k).cast("string")).try_cast("double") == s["size"]
            out = out.when(F.coalesce(same, F.lit(False)), F.struct(rounded.alias("digits"), (s["power"] + k).alias("power")))
        return out.otherwise(F.struct(s["digits"].alias("digits"), s["power"].alias("power")))

    def trimmed(s: Column) -> Column:
        short = F.rtrim(s["digits"], F.lit("0"))
        at = s["power"] + F.length(s["digits"]) - F.length(short)  # of the last digit
        return F.struct(F.ltrim(short, F.lit("0")).alias("digits"), at.alias("at"))

    def plain(s: Column) -> Column:
        digits, at = s["digits"], s["at"]
        n = F.length(digits)
        spread = F.when(at >= 0, F.concat(digits, F.repeat(F.lit("0"), at)))
        spread = spread.when(n + at > 0, F.concat(F.substring(digits, F.lit(1), n + at), F.lit("."), F.substring(digits, n + at + 1, n)))
        spread = spread.otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -(n + at)), digits))
        return F.when(digits == "", "0").otherwise(spread)

    # most numbers come without an exponent
    usual = F.when(x == 0, "0").otherwise(F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")))
    number = F.struct(F.abs(x).cast("double").alias("size"), F.abs(x).cast("string").alias("text"))
    moved = _once(_once(_once(_once(number, given), shown), trimmed), plain)
    return F.when(~text.contains("E"), usual).when(text.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), moved))


def canonical_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """``name=value`` of the columns, by name; doubles as canonical decimals, nulls as an empty mark."""
    kinds = dict(df.dtypes)
    parts = []
    for name in sorted(columns or df.columns):
        shown = canonical_decimal(F.col(name)) if kinds[name] in ("double", "float") else F.col(name).cast("string")
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(shown, F.lit(EMPTY))))
    return F.concat_ws(UNIT, *parts)


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(canonical_text(df, columns), 256)


def digest_of(hashes: str = "row_hash") -> list[Column]:
    """Aggregates ``row_count`` and ``rows_digest`` of a column of 64-digit hashes.

    The hashes' four 64-bit parts are summed, so the digest needs no order, no list and no second stage: its memory
    is the same for any number of rows. Repeated rows count.
    """
    lanes = [F.sum(x) for x in lanes_of(hashes)]
    shown = [F.coalesce(x.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string") for x in lanes]
    return [F.count("*").alias("row_count"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *shown), 256).alias("rows_digest")]


def lanes_of(hashes: str) -> list[Column]:
    """The four numbers of a 64-digit hash whose sums make a digest."""
    return [F.conv(F.substring(hashes, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]


def digest_of_sums(count: int, sums: Sequence[int]) -> str:
    """What ``digest_of`` gives for rows of this count and these sums of lanes."""
    return hashlib.sha256(":".join(map(str, (count, *sums))).encode()).hexdigest()


def rows_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``row_count, rows_digest`` of the rows of ``df``, whatever their order or partitioning."""
    return df.select(row_digest(df, columns).alias("row_hash")).agg(*digest_of())


def encoded_value(value_type: Column, value_long: Column, value_double: Column) -> Column:
    """A typed value: kind null, integer or float, with the float as canonical decimal text."""
    empty = F.when(value_type == "integer", value_long.isNull()).otherwise(value_double.isNull())
    return F.struct(
        F.when(empty, "null").when(value_type == "integer", "integer").otherwise("float").alias("kind"),
        F.when(value_type == "integer", value_long).alias("integer"),
        F.when(value_type != "integer", canonical_decimal(value_double)).alias("decimal"),
    )


def value_is_sound(value: Column) -> Column:
    """Whether an encoded value has one of the three shapes."""
    integer, decimal = value["integer"], value["decimal"]
    null = (value["kind"] == "null") & integer.isNull() & decimal.isNull()
    whole = (value["kind"] == "integer") & integer.isNotNull() & decimal.isNull()
    real = (value["kind"] == "float") & integer.isNull() & decimal.try_cast("double").isNotNull()
    return F.coalesce(null | whole | real, F.lit(False))


def decoded_value(value: Column) -> Column:
    """The number of an encoded value as double; null for kind null and unsound values."""
    return F.when(value["kind"] == "integer", value["integer"].cast("double")).when(value["kind"] == "float", value["decimal"].try_cast("double"))


def partition_key(customer: str = "customer_id", generation: str = "generation_id") -> Column:
    return F.concat(F.lit("ENTITY#"), F.col(customer).cast("string"), F.lit("#GEN#"), F.col(generation))


def sort_key(feature: str = "feature_name", definition: str = "definition_digest") -> Column:
    return F.concat(F.lit("FEATURE#"), F.col(feature), F.lit("#DEF#"), F.col(definition))


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("bigint")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in the order given; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in pairs]))
