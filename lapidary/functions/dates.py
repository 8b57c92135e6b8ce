"""Partial and BCE dates, which no SQL date type can hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"^([+-])([0-9]+)-([0-9]{2})-([0-9]{2})"

# Roman digits for hundreds, tens and ones.
_HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


def roman(number: Column) -> Column:
    n = number.cast("long")
    thousands = F.floor(n / 1000).cast("int")

    def digit(names: list[str], unit: int) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(n / unit) % 10 + 1).cast("int"))

    return F.concat(F.repeat(F.lit("M"), thousands), digit(_HUNDREDS, 100), digit(_TENS, 10), digit(_ONES, 1))


def partial_date(time: Column, precision: Column) -> Column:
    """``struct<valor,precisao,exibicao>`` of an entity time value, null when it is not one."""
    sign, digits, month, day = (F.regexp_extract(time, _TIME, i) for i in range(1, 5))
    year = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    padded = F.when(F.length(year) < 4, F.lpad(year, 4, "0")).otherwise(year)
    number = year.try_cast("long")
    century = F.floor((number + 99) / 100)
    decade = F.when(F.length(year) < 2, F.lit("0")).otherwise(F.regexp_replace(year, r"[0-9]\z", "0"))
    era = F.when(sign == "-", F.lit(" a.C.")).otherwise(F.lit(""))
    has_month, has_day = month != "00", day != "00"

    def shaped(kind: str, *parts: Column) -> Column:
        return F.struct(F.lit(kind).alias("precisao"), F.concat(*parts, era).alias("exibicao"))

    slash = F.lit("/")
    shown = (
        F.when((precision >= 11) & has_month & has_day, shaped("dia", day, slash, month, slash, padded))
        .when((precision == 10) & has_month, shaped("mes", month, slash, padded))
        .when(precision == 7, shaped("seculo", F.lit("século "), roman(century)))
        .when(precision == 8, shaped("decada", F.lit("década de "), decade))
        .otherwise(shaped("ano", year))
    )
    value = F.concat(F.when(sign == "-", sign).otherwise(F.lit("")), padded, F.lit("-"), month, F.lit("-"), day)
    return F.when(
        time.rlike(_TIME) & precision.isNotNull(),
        F.struct(value.alias("valor"), shown["precisao"].alias("precisao"), shown["exibicao"].alias("exibicao")),
    )
