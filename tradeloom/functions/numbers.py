"""Locale number parsers as column expressions. All strip to digits, commas, points and minus signs first.

Two extractors and two comparers each read numbers in their own way; results
that differ are part of the semantics, so all four exist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bare(x: Column | str) -> Column:
    return F.regexp_replace(_col(x).cast("string"), r"[^0-9,.\-]", "")


def _double(s: Column) -> Column:
    return s.try_cast("double")


def _points(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("."))


def _without(s: Column, c: str) -> Column:
    return F.replace(s, F.lit(c), F.lit(""))


def _right_most(s: Column) -> Column:
    """Both separators: the right-most is the decimal one."""
    comma = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    return F.when(comma, _points(_without(s, "."))).otherwise(_without(s, ","))


def _last_is_decimal(s: Column, c: str) -> Column:
    """Join all parts but the last; the last follows a point."""
    last = F.substring_index(s, c, -1)
    head = F.left(s, F.length(s) - F.length(last) - 1)
    return F.concat(_without(head, c), F.lit("."), last)


def _has(s: Column) -> tuple[Column, Column]:
    return s.contains(","), s.contains(".")


def once(x: Column | str, body: Callable[[Column], Column]) -> Column:
    """A parser's body of x, where x is found and stripped once and not for each use; for values that lambdas give, which are not shared by themselves."""
    return let(_bare(x), body)


def parse_number_import(x: Column | str) -> Column:
    """P1: grouped commas or several grouped points are thousands; one point is decimal."""
    return number_import(_bare(x))


def number_import(s: Column) -> Column:
    comma, point = _has(s)
    return _double(
        F.when(comma & point, _right_most(s))
        .when(comma, F.when(s.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+$"), _without(s, ",")).otherwise(_points(s)))
        .when(s.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3}){2,}$"), _without(s, "."))
        .otherwise(s)
    )


def parse_number_export(x: Column | str) -> Column:
    """P2: a lone comma is decimal; of several equal separators the last is decimal."""
    return number_export(_bare(x))


def number_export(s: Column) -> Column:
    comma, point = _has(s)
    return _double(
        F.when(comma & point, _right_most(s))
        .when(comma, F.when(s.rlike(",.*,"), _last_is_decimal(s, ",")).otherwise(_points(s)))
        .when(s.rlike(r"\..*\."), _last_is_decimal(s, "."))
        .otherwise(s)
    )


def to_float_import(x: Column | str) -> Column:
    """P3, of strings: three digits after a lone separator are thousands, whichever separator."""
    s = _bare(x)
    comma, point = _has(s)

    def lone(c: str) -> Column:
        left = F.substring_index(s, c, 1)
        right = F.substring(s, F.length(left) + F.lit(2), F.lit(1 << 30))
        return F.when((F.length(right) == 3) & (F.length(left) <= 3), F.concat(left, right))

    return _double(
        F.when(s.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), _without(s, ","))
        .when(s.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"), _points(_without(s, ".")))
        .when(comma & point, _right_most(s))
        .when(comma, F.coalesce(lone(","), F.regexp_replace(s, "^([^,]*),", "$1.")))
        .when(point, F.coalesce(lone("."), s))
        .otherwise(s)
    )


def to_float_export(x: Column | str) -> Column:
    """P4, of strings: commas are points unless a point follows."""
    s = _bare(x)
    comma, point = _has(s)
    return _double(
        F.when(comma & point, _right_most(s))
        .when(comma, _points(s))
        .when(s.rlike(r"\..*\."), _last_is_decimal(s, "."))
        .otherwise(s)
    )


def parse_int_digits(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), "[^0-9]", "").try_cast("bigint")


def parse_cnpj(x: Column | str) -> Column:
    """The 14 digits of a tax number, or null."""
    d = F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), "[^0-9]", "")
    return F.when(F.length(d) == 14, d)
