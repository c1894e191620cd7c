"""Cleaning, normalising and searching of text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as universal newlines and the separators of Unicode.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: All white space of Unicode, as (?U)\s matches it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Accented Latin letters and their base letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), where value is computed once per row and not once per use in a lambda."""
    return F.transform(F.array(value), body)[0]


def strip(x: Column | str) -> Column:
    """Without white space of any kind at the ends; only characters at the ends are looked at."""
    return F.btrim(_col(x), F.lit(SPACES))


def clean_text(x: Column | str) -> Column:
    """Page text: no NUL, single blanks, at most one empty line."""
    s = F.regexp_replace(_col(x), r"\x00", "")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def normalize_spaces(x: Column | str) -> Column:
    """Import: no-break spaces are blanks, blanks are single, line ends stay."""
    return F.regexp_replace(F.replace(_col(x), F.lit("\xa0"), F.lit(" ")), r" [ \t]+|\t[ \t]*", " ")


def collapse_spaces(x: Column | str) -> Column:
    """Export: all white space is one blank, none at the ends."""
    return strip(F.regexp_replace(_col(x), r"(?U)\s+", " "))


def search_form(x: Column | str) -> Column:
    return F.lower(collapse_spaces(x))


def digits_only(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), "[^0-9]", "")


def strip_accents(x: Column | str) -> Column:
    """Base letters; a text of ASCII alone, that is as many bytes as characters, is not looked through."""
    t = _col(x)
    return F.when(F.octet_length(t) == F.char_length(t), t).otherwise(F.translate(t, ACCENTED, PLAIN))


def norm_str_import(x: Column | str) -> Column:
    s = F.replace(F.upper(strip(F.coalesce(_col(x).cast("string"), F.lit("")))), F.lit("Ç"), F.lit("C"))
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "[^A-Z0-9 ]+", "")
    return F.btrim(F.regexp_replace(s, " {2,}", " "))


def norm_str_export(x: Column | str) -> Column:
    """As for import, but a cedilla deletes its letter and blanks are not made single again."""
    s = F.upper(strip(F.coalesce(_col(x).cast("string"), F.lit(""))))
    return F.btrim(F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "[^A-Z0-9 ]+", ""))


def lines(text: Column | str, keep_empty: bool = False) -> Column:
    """Stripped lines; empty ones only where asked for."""
    every = F.transform(F.split(_col(text), LINE_END), strip)
    return every if keep_empty else F.filter(every, lambda x: x != "")


def lines_collapsed(text: Column | str) -> Column:
    """Export: lines with single blanks, empty ones dropped."""
    return F.filter(F.transform(F.split(_col(text), LINE_END), collapse_spaces), lambda x: x != "")


def find(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    t = _col(text)
    return F.when(t.rlike(pattern), strip(F.regexp_extract(t, pattern, group)))


def find_any(text: Column | str, patterns: Sequence[str], group: int = 1) -> Column:
    return F.coalesce(*[find(text, p, group) for p in patterns])


def find_all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))


def first_where(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def section(ls: Column, head: str, end: str, most: int = 40) -> Column:
    """Lines below the heading, up to the end mark or `most` lines; null without a heading."""
    i = F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(ls) - 1, F.lit(0))), lambda k: F.coalesce(F.get(ls, k).rlike(head), F.lit(False))), F.lit(0))
    part = F.slice(ls, i + 2, F.lit(most))
    n = F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(part) - 1, F.lit(0))), lambda k: F.coalesce(F.get(part, k).rlike(end), F.lit(False))), F.lit(0))
    return F.when(i.isNotNull(), F.slice(part, F.lit(1), F.coalesce(n, F.size(part))))


def truncate_evidence(items: Column, most: int = 220) -> Column:
    said = F.filter(F.transform(items, lambda x: strip(normalize_spaces(x))), lambda x: x.isNotNull() & (x != ""))
    return F.transform(said, lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x))


def evidence_lines(ls: Column, token: Column | str, most: int = 2) -> Column:
    return let(F.lower(_col(token)), lambda t: F.slice(F.filter(ls, lambda x: F.contains(F.lower(x), t)), 1, most))
