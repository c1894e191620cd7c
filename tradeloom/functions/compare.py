"""Comparators of two extracted values as column expressions. All give true or false, never null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_only, let, norm_str_export, norm_str_import

JACCARD = 0.55
#: Words that do not identify a shipper; codes of delivery terms; the side that pays the freight.
SHIPPER_WORDS = ["LTDA", "LTD", "S", "A", "SA", "INC", "LLC", "CORP", "CORPORATION", "COMPANY", "CO", "INDUSTRIA", "INDUSTRIAL", "COMERCIO", "COMERCIAL", "LOGISTICS", "LOGIX", "MOTOR", "MOTORS", "OUTBOARD", "EXPORT", "EXPORTER", "SHIPPER"]
INCOTERMS = ["EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP", "DAT"]
FREIGHT = {"FOB": "COLLECT", "FCA": "COLLECT", "EXW": "COLLECT", "CFR": "PREPAID", "CIF": "PREPAID", "CPT": "PREPAID", "CIP": "PREPAID", "DAP": "PREPAID", "DPU": "PREPAID", "DDP": "PREPAID"}
FREIGHT_EXPORT = FREIGHT | {"FAS": "COLLECT"}


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _both(a: Column, b: Column, norm: Callable[[Column], Column], body: Callable[[Column, Column], Column]) -> Column:
    """body of the two normalised values, each normalised once and not once per use; never null."""
    return _sure(let(F.struct(norm(a).alias("x"), norm(b).alias("y")), lambda v: body(v["x"], v["y"])))


def number_close(a: Column, b: Column, abs_tol: Column | float = 1.0, rel_tol: Column | float = 0.01) -> Column:
    d = F.abs(a - b)
    return _sure((d <= abs_tol) | (d / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= rel_tol))


def _tokens(x: Column) -> Column:
    return F.array_distinct(F.split(x, " +"))


def _jaccard(a: Column, b: Column) -> Column:
    x, y = _tokens(a), _tokens(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) >= JACCARD


def _alike_import(x: Column, y: Column) -> Column:
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x) | _jaccard(x, y))


def _alike_export(x: Column, y: Column) -> Column:
    return (x != "") & (y != "") & ((x == y) | _jaccard(x, y))


def _same(x: Column, y: Column) -> Column:
    return (x != "") & (x == y)


def string_close_import(a: Column, b: Column) -> Column:
    """Equal when normalised, words alike, or the shorter within the longer."""
    return _both(a, b, norm_str_import, _alike_import)


def string_close_export(a: Column, b: Column) -> Column:
    return _both(a, b, norm_str_export, _alike_export)


def cnpj_close(a: Column, b: Column) -> Column:
    return _both(a, b, digits_only, _same)


def docref_key_import(x: Column) -> Column:
    """Equal keys are equal references: one trailing P is a copy mark. Null where nothing is left to compare."""
    return let(F.regexp_replace(norm_str_import(x), "[^A-Z0-9]", ""), lambda s: F.when(s != "", F.regexp_replace(s, "P$", "")))


def docref_key_export(x: Column) -> Column:
    return let(F.regexp_replace(norm_str_export(x), "[^A-Z0-9]", ""), lambda s: F.when(s != "", F.regexp_replace(s, "P+$", "")))


def docref_close_import(a: Column, b: Column) -> Column:
    return _sure(docref_key_import(a) == docref_key_import(b))


def docref_close_export(a: Column, b: Column) -> Column:
    return _sure(docref_key_export(a) == docref_key_export(b))


def docref_set_close(a: Column, b: Column) -> Column:
    """Arrays: any reference of one side is one of the other."""
    keys = lambda v: F.filter(F.transform(v, docref_key_import), lambda x: x.isNotNull())
    return _sure(F.arrays_overlap(keys(a), keys(b)))


def _part(x: Column, y: Column) -> Column:
    """Of two codes the shorter has 4 or 6 digits and begins the longer."""
    begins = lambda s, t: F.length(s).isin(4, 6) & (F.length(s) < F.length(t)) & F.startswith(t, s)
    return begins(x, y) | begins(y, x)


def ncm_close(a: Column, b: Column) -> Column:
    """Tariff codes: equal, or the shorter has 4 or 6 digits and begins the longer."""
    return _both(a, b, digits_only, _same_or_part)


def _same_or_part(x: Column, y: Column) -> Column:
    return _same(x, y) | _part(x, y)


def part_note(x: Column, y: Column) -> Column:
    """ncm_note of the digits of two codes."""
    return F.when(_part(x, y), F.concat(F.lit("partial_hs_"), F.least(F.length(x), F.length(y)).cast("string")))


def ncm_note(a: Column, b: Column) -> Column:
    return let(F.struct(digits_only(a).alias("x"), digits_only(b).alias("y")), lambda v: part_note(v["x"], v["y"]))


def set_close(a: Column, b: Column) -> Column:
    norm = lambda v: F.array_sort(F.array_distinct(F.filter(F.transform(v, norm_str_import), lambda x: x != "")))
    return _sure(norm(a) == norm(b))


def shipper_close(a: Column, b: Column) -> Column:
    drop = F.array(*[F.lit(w) for w in SHIPPER_WORDS + INCOTERMS])
    said = lambda v: F.array_except(F.filter(F.split(norm_str_import(v), " +"), lambda t: F.length(t) >= 4), drop)
    return _sure(string_close_import(a, b) | F.arrays_overlap(said(a), said(b)))


def freight_mode(x: Column) -> Column:
    return let(norm_str_import(x), lambda s: F.when(s.contains("COLLECT"), "COLLECT").when(s.contains("PREPAID"), "PREPAID").otherwise(s))


def expected_freight(incoterm: Column, export: bool = False) -> Column:
    """The side that pays by the term, null where the term has none."""
    it = F.upper(F.btrim(incoterm)) if export else F.btrim(F.replace(norm_str_import(incoterm), F.lit("INCOTERMS"), F.lit("")))
    modes = F.create_map(*[F.lit(x) for kv in (FREIGHT_EXPORT if export else FREIGHT).items() for x in kv])
    return F.try_element_at(modes, it)


#: How texts are compared, by kind of check: the form of each side, made once, and whether two forms are close (null counts as not).
_CODE = (digits_only, _same_or_part)
IMPORT: dict[str, tuple[Callable, Callable]] = {"string": (norm_str_import, _alike_import), "cnpj": (digits_only, _same), "docref": (docref_key_import, Column.__eq__), "ncm_hs": _CODE, "code_prefix": _CODE}
EXPORT: dict[str, tuple[Callable, Callable]] = {"string": (norm_str_export, _alike_export), "cnpj": (digits_only, _same), "docref": (docref_key_export, Column.__eq__), "code_prefix": _CODE}
