"""Field extraction from document text: kinds, fields and their rules as column expressions.

A rule is a function of (text, lines) that gives a column; a kind is a table of
(field, required, rule). Texts are split into lines once, all fields of a kind
are one projection, and kinds are filtered projections that are united: no
Python runs per row, and a new field is a new table row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import INCOTERMS, expected_freight
from ..functions.numbers import number_export, number_import, once, parse_cnpj, parse_int_digits
from ..functions.text import collapse_spaces, digits_only, find, find_all, find_any, first_where, let, lines, lines_collapsed, normalize_spaces, strip, strip_accents

Rule = Callable[[Column, Column], Column]

# The aliases of document kinds, as hints give them.
HINTS_IMPORT = {"invoice": "invoice", "commercial_invoice": "invoice", "packing_list": "packing_list", "packing list": "packing_list", "pl": "packing_list", "bl": "bl", "hbl": "hbl", "bill_of_lading": "bl", "di": "di", "li": "li"}
HINTS_EXPORT = {"commercial_invoice": "commercial_invoice", "invoice": "commercial_invoice", "packing_list": "packing_list", "packing": "packing_list", "draft_bl": "draft_bl", "bl": "draft_bl", "certificate_of_origin": "certificate_of_origin", "coo": "certificate_of_origin", "container_data": "container_data"}
# Long forms of delivery terms.
TERM_PHRASES = [("DELIVERED AT PLACE UNLOADED", "DPU"), ("DELIVERED DUTY PAID", "DDP"), ("DELIVERED AT PLACE", "DAP"), ("CARRIAGE AND INSURANCE PAID TO", "CIP"), ("CARRIAGE PAID TO", "CPT"), ("COST INSURANCE AND FREIGHT", "CIF"), ("COST AND FREIGHT", "CFR"), ("FREE ON BOARD", "FOB"), ("FREE ALONGSIDE SHIP", "FAS"), ("FREE CARRIER", "FCA"), ("EX WORKS", "EXW")]
TAX_ID = r"([0-9]{2}[.\s]?[0-9]{3}[.\s]?[0-9]{3}[/\s]?[0-9]{4}[-\s]?[0-9]{2})"
DAY = r"\b([0-9]{2}/[0-9]{2}/[0-9]{4})\b"
CODE = r"(?i)\bN\.?C\.?M\.?\b[:\s\-]*([0-9.]{4,})"
SUFFIX = r"(?i)\b(LTDA|LTD|INC|CORP|COMPANY|IND\.?|INDUSTRIA|COMERCIO|SHIPPING)\b"
# Words that no company line of either flow has, and addresses.
NOT_A_COMPANY = r"(?i)\b(BILL OF|CERTIFICATE|CERTIFICAT|ORIGINE|ORIGEN|PROCEDENCIA|PROVENANCE|INVOICE|PACKING|PESO|WEIGHT|COUNTRY|CITY|PORT|CONTAINER|CARTONS|PALLETS|RUC|NCM|DUE|FREIGHT|PREPAID|COLLECT|PAGE|PHONE|FAX|E-MAIL|WEB|TERMS|OBS|INSC|ESTRADA|DESTINO|DESTINATION|EXPORTADOR|EXPORTATEUR|IMPORTADOR)\b"
ADDRESS = r"(?i)\b(ROAD|RUA|AVENUE|AV\.|STREET|KM|BOULEVARD|BLVD)\b|@|https?://|\b[0-9]{2}/[0-9]{2}/[0-9]{2,4}\b|^/"
NOISE_IMPORT = r"(?i)\b(SHIP\s*TO|BILL\s*TO|COD\.?\s*CLIENTE|COD\.?\s*FISCALE|P\.?\s*IVA|ZIP|PAGINA|PAGE|DATA/DATE|TIPO/TYPE|PAYMENT\s+TERMS|INVOICE_EXT|DESCRIZIONE|DESCRIPTION|ARTICOLO|VAT|IBAN|SWIFT|AGENTE|BANCA|RUA|VIA|BRAZIL|LOUVEIRA|MONZA|RIETI)\b|@|https?://"
LEGAL_IMPORT = r"(?i)\b(LTDA|LTD|S\.?\s*P\.?\s*A\.?|S\.?\s*R\.?\s*L\.?|S\.?\s*A\.?|INC|CORP|GMBH|CO\.?)\b"


def parse_number_export(x: Column) -> Column:
    return once(x, number_export)


def parse_number_import(x: Column) -> Column:
    return once(x, number_import)


def clean_token(x: Column) -> Column:
    """A value without blanks, colons and dashes at its ends; null if it says nothing."""
    said = lambda s: F.when((s == "") | s.rlike(r"^[.\-_/\\:]+$") | F.upper(s).isin("N/A", "NA", "NONE", "NULL", "NIL"), None).otherwise(s)
    return let(F.btrim(collapse_spaces(x), F.lit(" \t\r\n:-")), said)


def _indexes(ls: Column, pattern: str) -> Column:
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(ls) - 1, F.lit(0))), lambda i: F.coalesce(F.get(ls, i).rlike(pattern), F.lit(False)))


def _first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def label(labels: str, value: str = ".", reject: str | None = None, ahead: int = 8) -> Rule:
    """The token after the label on its line, else the first fit one of the next lines; labels from the top."""
    mark = f"(?i){labels}"

    def fit(x: Column) -> Column:
        ok = x.isNotNull() & x.rlike(f"(?i){value}")
        return ok & ~x.rlike(f"(?i){reject}") if reject else ok

    def rule(t: Column, ls: Column) -> Column:
        def at(i: Column) -> Column:
            below = _first(F.filter(F.transform(F.slice(ls, i + 2, F.lit(ahead)), clean_token), fit))
            return let(clean_token(F.regexp_replace(F.get(ls, i), f"^.*?(?:{mark})", "")), lambda inline: F.when(fit(inline), inline).otherwise(below))

        return _first(F.filter(F.transform(_indexes(ls, mark), at), lambda v: v.isNotNull()))

    return rule


def pattern(*patterns: str, group: int = 1) -> Rule:
    return lambda t, ls: find_any(t, patterns, group)


def number(of: Rule, parser=parse_number_export) -> Rule:
    return lambda t, ls: parser(of(t, ls))


def first_of(*rules: Rule) -> Rule:
    return lambda t, ls: F.coalesce(*[r(t, ls) for r in rules])


def weight(labels: str, ahead: int = 16) -> Rule:
    """A number with a unit on a label's line, else the first bare number below it."""

    def rule(t: Column, ls: Column) -> Column:
        def at(i: Column) -> Column:
            inline = find(F.get(ls, i), r"(?i)([0-9][0-9.,]*)\s*(?:KGS?|M3|CBM)\b")
            below = F.filter(F.slice(ls, i + 2, F.lit(ahead)), lambda x: x.rlike(r"^[0-9][0-9.,]*$"))
            return parse_number_export(F.coalesce(inline, _first(below)))

        return _first(F.filter(F.transform(_indexes(ls, f"(?i){labels}"), at), lambda v: v.isNotNull()))

    return rule


def bare_numbers(t: Column, ls: Column) -> Column:
    """The first two bare numbers below the later of both weight labels."""
    start = F.greatest(_first(_indexes(ls, r"(?i)\bPESO\s+BRUTO\b|\bGROSS\s+WEIGHT\b")), _first(_indexes(ls, r"(?i)\bPESO\s+NETO\b|\bNET\s+WEIGHT\b")))
    bare = F.filter(F.slice(ls, start + 2, F.lit(29)), lambda x: x.rlike(r"^[0-9.,]+$"))
    return F.slice(F.filter(F.transform(bare, parse_number_export), lambda v: v.isNotNull()), 1, 2)


def stacked_weight(which: int, labels: str) -> Rule:
    """Two bare numbers below the later of both weight labels are gross and net; else the label's own."""
    return lambda t, ls: F.coalesce(F.when(F.size("shared_numbers") >= 2, F.get("shared_numbers", F.lit(which))), weight(labels)(t, ls))


def incoterm_export(t: Column, ls: Column) -> Column:
    token = r"(?i)\b(" + "|".join(x for x in INCOTERMS if x != "DAT") + r")\b"
    near = F.transform(_indexes(ls, r"(?i)\bINCOTERM"), lambda i: _first(F.filter(F.transform(F.slice(ls, i + 1, F.lit(5)), lambda x: find(x, token)), lambda v: v.isNotNull())))
    return F.upper(F.coalesce(_first(F.filter(near, lambda v: v.isNotNull())), find(t, token)))


def incoterm_import(t: Column, ls: Column) -> Column:
    said = None
    for words, code in TERM_PHRASES:
        said = (F if said is None else said).when(t.rlike(r"(?i)\b" + words.replace(" ", r"\s+") + r"\b"), code)
    said = said.when(t.rlike(r"(?i)\bF\.?\s*C\.?\s*A\.?\b"), "FCA")
    return said.otherwise(F.upper(find(t, r"(?i)\b(" + "|".join(INCOTERMS) + r")\b")))


def cnpj_export(t: Column, ls: Column) -> Column:
    return F.coalesce(parse_cnpj(find(t, r"(?i)\bC\.?\s*N\.?\s*P\.?\s*J\.?\b[:\s\-]*([0-9.\-/ ]+)")), parse_cnpj(find(t, TAX_ID)))


def cnpj_import(t: Column, ls: Column) -> Column:
    chunks = find_all(t, r"(?is)\b(?:CNPJ|P\.?\s*IVA|PARTITA\s+I\.?\s*V\.?\s*A\.?|COD\.?\s*FISCALE(?:\s*P\.?\s*IVA)?)\b\s*[:\-]?\s*([A-Z0-9.\-/\s]{8,30})", 1)
    hits = F.filter(F.transform(chunks, lambda c: parse_cnpj(find(c, TAX_ID))), lambda v: v.isNotNull())
    return F.coalesce(_first(hits), parse_cnpj(find(t, TAX_ID)))


def company_line(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.btrim(collapse_spaces(x), F.lit(" -:")), r"(?i)^(?:CONSIGNEE|SHIPPER|EXPORTER|IMPORTER|NOTIFY(?:\s+PARTY)?)\b[:\s\-]*", ""), F.lit(" -:"))


def looks_company(x: Column) -> Column:
    return (F.length(x) >= 4) & ~x.rlike(NOT_A_COMPANY) & ~x.rlike(ADDRESS) & (F.size(F.regexp_extract_all(x, F.lit("[A-Za-z]{2,}"), F.lit(0))) >= 2)


def looks_company_import(x: Column) -> Column:
    """Two words at least, a legal suffix or all capitals, no heading and no address."""
    words = F.size(F.regexp_extract_all(x, F.lit("[A-Za-z]{2,}"), F.lit(0))) >= 2
    return (F.length(x) >= 6) & ~x.rlike(NOISE_IMPORT) & words & (x.rlike(LEGAL_IMPORT) | (x == F.upper(x)))


def _companies_import(part: Column) -> Column:
    return F.filter(F.transform(part, lambda x: F.btrim(normalize_spaces(x), F.lit(" -:\t"))), looks_company_import)


def line_before_cnpj(t: Column, ls: Column) -> Column:
    """The nearest line above a tax number; lines have no empty ones."""
    i = _first(_indexes(ls, r"(?i)\bCNPJ\b|" + TAX_ID))
    return F.when(i > 0, F.get(ls, i - 1))


def beside_tax_label(t: Column, ls: Column) -> Column:
    """The first company two lines or one above a tax label, or one or two below it, labels from the top."""
    marks = _indexes(ls, r"(?i)\b(?:CNPJ|P\.?\s*IVA|COD\.?\s*FISCALE)\b")
    near = F.flatten(F.transform(marks, lambda i: F.transform(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)]), lambda k: F.when(i + k >= 0, F.get(ls, i + k)))))
    return _first(_companies_import(F.filter(near, lambda x: x.isNotNull())))


# The beginnings of known shippers' names.
KNOWN_SHIPPER = r"(?is)\b((?:SUZUKI|INJECTA)[^\n]{0,120})\b"


def shipper_invoice(t: Column, ls: Column) -> Column:
    """A known name; else up to nine lines above SHIP TO, the nearest first; else the first of twelve that looks like a company."""
    i = _first(_indexes(ls, r"(?i)\bSHIP\s*TO\b"))
    start = F.greatest(i - 9, F.lit(0))
    return F.coalesce(normalize_spaces(find(t, KNOWN_SHIPPER)), _first(_companies_import(F.reverse(F.slice(ls, start + 1, i - start)))), _first(_companies_import(F.slice(ls, 1, 12))))


def shipper_bl(t: Column, ls: Column) -> Column:
    """The first fit of seven lines below SHIPPER, without long numbers at its end; else what follows on the line."""
    i = _first(_indexes(ls, r"(?i)\b(SHIPPER|CONSIGNOR|CONSIGNER)\b"))
    below = F.filter(F.slice(ls, i + 2, F.lit(7)), lambda x: ~x.rlike(r"(?i)CONSIGNEE|NOTIFY|BOOKING|B/L"))
    names = F.transform(below, lambda x: F.regexp_replace(strip(x), r"(?:\s+(?=\S*[0-9])\S{6,})+$", ""))
    return F.coalesce(_first(F.filter(names, lambda x: F.length(x) >= 3)), find(t, r"(?im)\bSHIPPER\b\s*:?\s*(.+)$"))


def total_packing(which: int, own: str) -> Rule:
    """Packages, net, gross, volume of the one-line total; else the label's own, on a line and the next one."""
    row = r"(?i)\bTOTAL\b\s*:?\s*([0-9]+)\s*CARTONS?\s+([0-9.,]+)\s+([0-9.,]+)\s+([0-9.,]+)"

    def rule(t: Column, ls: Column) -> Column:
        total = let(_first(F.filter(ls, lambda x: x.rlike(row))), lambda x: find(x, row, which))
        two = F.transform(ls, lambda x, i: F.concat_ws(" ", x, F.get(ls, i + 1)))
        return F.coalesce(total, _first(F.filter(F.transform(two, lambda x: find(x, own)), lambda v: v.isNotNull())))

    return rule


def _companies(part: Column) -> Column:
    return F.filter(F.transform(part, company_line), looks_company)


def company_before_cnpj(t: Column, ls: Column) -> Column:
    """Up to seven lines above a tax number: one with a legal suffix, else the nearest company line."""

    def at(i: Column) -> Column:
        start = F.greatest(i - 7, F.lit(0))
        return let(_companies(F.reverse(F.slice(ls, start + 1, i - start))), lambda cands: F.coalesce(_first(F.filter(cands, lambda x: x.rlike(SUFFIX))), _first(cands)))

    marks = F.filter(_indexes(ls, r"(?i)\bC\.?\s*N\.?\s*P\.?\s*J\.?\b"), lambda i: i > 0)
    return _first(F.filter(F.transform(marks, at), lambda v: v.isNotNull()))


def company_after_cnpj(t: Column, ls: Column, before: Column | None = None) -> Column:
    i = _first(_indexes(ls, r"(?i)\bC\.?\s*N\.?\s*P\.?\s*J\.?\b"))
    other = F.lower(company_before_cnpj(t, ls) if before is None else before)
    return let(other, lambda o: _first(F.filter(_companies(F.slice(ls, i + 2, F.lit(23))), lambda x: ~F.lower(x).eqNullSafe(o))))


def clean_company(x: Column, packing: bool = False) -> Column:
    """A company's name without what runs into its line: clauses, contacts, all behind a legal suffix."""
    s = F.regexp_replace(collapse_spaces(x), r"(?i)\bVEICU\s+LOS\b", "VEICULOS")
    s = strip(F.regexp_replace(s, r"(?i)^(.+?) (?:RECEIVED|PARTY TO CONTACT|TEL|PHONE|PH:).*$", "$1"))
    if packing:
        s = strip(F.regexp_replace(s, r"(?i)\b(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\.?\s+[0-9]{1,2},\s*[0-9]{4}\b", ""))
    # Legal suffixes; a packing list knows two fewer.
    more = "" if packing else r"|SRL|S\.?R\.?L\.?|S\.?P\.?A\.?|SPA"
    s = F.regexp_replace(s, rf"(?i)^(.*?\b(?:LTDA\.?|LTD\.?|S\.?A\.?|S/A|SA{more}|INC\.?|LLC|CORPORATION|CORP\.?)\b).*$", "$1")
    s = strip(F.regexp_replace(s, r"[\s,;\-]+$", ""))
    return let(s, lambda x: F.when(x != "", x))


def consignee_block(t: Column, ls: Column) -> Column:
    """name and cnpj of the consignee of a bill: the tax number within 25 lines of the block, the nearest fit line above it; else the first tax number alone."""
    tax = r"(?i)CNPJ\s*[:#]?\s*([0-9][0-9.\-/]{11,})"
    head = _first(_indexes(ls, r"(?i)\bCONSIGNEE\b|CONSIGNED\s+TO\s+THE\s+ORDER\s+OF"))

    def near(v: Column) -> Column:
        j = _first(F.filter(v["marks"], lambda k: (k > v["i"]) & (k <= v["i"] + 25)))
        return let(F.struct(v["i"].alias("i"), j.alias("j"), _first(v["marks"]).alias("first")), found)

    def found(v: Column) -> Column:
        i, j = v["i"], v["j"]
        start = F.greatest(i + 1, j - 9)
        above = F.filter(F.reverse(F.slice(ls, start + 1, F.greatest(j - start, F.lit(0)))), lambda x: ~x.rlike(r"(?i)\b(CON...|CONSIGNED|NOTIFY|CNPJ|TEL|PHONE)\b"))
        number_ = F.coalesce(F.get(ls, j), F.get(ls, v["first"]))
        return F.struct(let(_first(above), lambda x: clean_company(x)).alias("name"), let(digits_only(find(number_, tax)), lambda x: F.nullif(x, F.lit(""))).alias("cnpj"))

    return let(F.struct(head.alias("i"), _indexes(ls, tax).alias("marks")), near)


# Words of lines that are no port.
NOT_A_PORT = r"EMAIL|E-MAIL|TEL|FAX|CNPJ|IVA|CAP\.SOC|CAP SOC|TRIB|C\.C\.|PORT OF|PLACE OF|DELIVERY"


def port_like(x: Column) -> Column:
    return ~F.upper(x).rlike(NOT_A_PORT) & (F.length(F.regexp_replace(x, r"\P{L}", "")) >= 3)


def port(which: str, vessel: bool = False) -> Rule:
    """The last fit value on a label's line; else the first fit line of three below the first label; else a word below a vessel line."""
    mark = rf"(?i)\bPORT\s+OF\s+{which}\b"

    def rule(t: Column, ls: Column) -> Column:
        said = F.transform(ls, lambda x: collapse_spaces(find(x, mark + r"\s*[:\-]?\s*(.+)$")))
        inline = F.try_element_at(F.filter(said, lambda v: v.isNotNull() & (v != "") & port_like(v) & ~v.contains("@")), F.lit(-1))
        i = _first(_indexes(ls, mark))
        below = _first(F.filter(F.slice(ls, i + 2, F.lit(3)), lambda x: ~x.rlike(r"(?i)\b(PORT\s+OF|PLACE\s+OF|E-MAIL|EMAIL)\b") & port_like(x)))
        out = F.coalesce(inline, collapse_spaces(below))
        if vessel:
            admin = r"(?i)\b(C\.C\.|IVA|P\.?\s*IVA|CAP\.?SOC|TRIB)\b.*$"
            rows = F.filter(_indexes(ls, mark), lambda k: F.get(ls, k).rlike(r"(?i)\b(?:OCEAN\s+VESSEL|VESSEL)\b"))
            words = lambda k: F.transform(F.slice(ls, k + 2, F.lit(2)), lambda x: F.try_element_at(F.regexp_extract_all(F.upper(F.regexp_replace(x, admin, "")), F.lit(r"\b([A-Z]{4,})\b"), F.lit(1)), F.lit(-1)))
            out = F.coalesce(out, _first(F.filter(F.flatten(F.transform(rows, words)), lambda v: v.isNotNull())))
        return out

    return rule


def invoice_number_import(t: Column, ls: Column) -> Column:
    """Of four patterns in order the first match that is a reference: trimmed, with a digit, of two characters at least."""
    texts = [
        r"(?is)\bINVOICE\s*(?:NO|N[Oº°.]?)\s*[:\-]?\s*([A-Z0-9\-/]+)\b",
        r"(?is)\b(?:FATTURA(?:\s+ACCOMPAGNATORIA)?|INVOICE(?:_EXT)?)\b[\s\S]{0,240}?\bN\.?\s*[:\-]?\s*([A-Z0-9\-/]{1,30})\b",
        r"(?is)\bN\.?\s*[:\-]?\s*([A-Z0-9\-/]{1,30})\s*(?:\r?\n|\s){0,20}\b(?:DATA|DATE|DATA/DATE)\b",
        r"(?is)\b([A-Z]{1,6}-[0-9]{3,10})\b",
    ]
    trimmed = F.transform(F.concat(*[find_all(t, p, 1) for p in texts]), lambda x: F.regexp_replace(x, r"^[.\-:/\s]+|[.\-:/\s]+$", ""))
    return _first(F.filter(trimmed, lambda x: (F.length(x) >= 2) & ~F.upper(x).isin("N", "NO", "O", "INVOICE") & x.rlike("[0-9]")))


def invoice_weights(t: Column, ls: Column) -> Column:
    """net and gross by their labels, and one weight for both where neither is there."""
    net, gross = (parse_number_import(find(t, rf"(?is)\b{w}\s*WEIGHT\b\s*[:\-]?\s*([0-9.,]+)\s*KGS?\b")) for w in ("NET", "GROSS"))
    one = parse_number_import(find(t, r"(?is)\b(?:PESO|WEIGHT)\b[\s\S]{0,80}\bKGS?\b[\s:]*([0-9][0-9.,]{0,20})"))
    return let(F.struct(net.alias("net"), gross.alias("gross")), lambda w: F.struct(w["net"].alias("net"), w["gross"].alias("gross"), F.when(w["net"].isNull() & w["gross"].isNull(), one).alias("one")))


def or_sum(item: str, total: str) -> Rule:
    """The stated total; where it is missing the sum over the items that have the value."""

    def rule(t: Column, ls: Column) -> Column:
        values = F.filter(F.transform("shared_items.items", lambda i: i[item]), lambda v: v.isNotNull())
        kind = "long" if item == "packages" else "double"
        return F.coalesce(F.col(f"shared_totals.{total}"), F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast(kind), lambda a, v: a + v)))

    return rule


def draft_parties(t: Column, ls: Column) -> Column:
    """Both parties, each found once: a bare struct would be put in for every use of a part of it."""
    return let(company_before_cnpj(t, ls), lambda e: F.struct(e.alias("exporter"), F.coalesce(company_after_cnpj(t, ls, e), consignee(t, ls)).alias("importer")))


def notify_by_mail(t: Column, ls: Column) -> Column:
    """The company line two above or directly above a line with an address of mail, that is neither party."""
    norm = lambda x: F.lower(collapse_spaces(x))
    mails = F.filter(_indexes(ls, "@"), lambda i: i >= 1)
    near = F.flatten(F.transform(mails, lambda i: F.array(F.when(i >= 2, F.get(ls, i - 2)), F.get(ls, i - 1))))
    lines_ = F.transform(F.filter(near, lambda x: x.isNotNull()), company_line)
    both = F.struct(norm(F.col("shared_parties.exporter")).alias("exporter"), norm(F.col("shared_parties.importer")).alias("importer"))

    def fit(p: Column) -> Column:
        other = lambda x: F.coalesce(norm(x) != p["exporter"], F.lit(True)) & F.coalesce(norm(x) != p["importer"], F.lit(True))
        return _first(F.filter(lines_, lambda x: looks_company(x) & other(x)))

    return F.when(F.size(mails) > 0, let(both, fit))


def consignee(t: Column, ls: Column) -> Column:
    return company_line(label(r"\bCONSIGNEE\b", reject=r"\b(not negotiable|consigned to order|phone|road)\b", ahead=10)(t, ls))


def certificate_company(which: int) -> Rule:
    """Companies of the first 160 lines: the exporter has a legal suffix or comes first, the importer is the next."""

    def rule(t: Column, ls: Column) -> Column:
        return F.col("shared_companies.exporter" if which == 0 else "shared_companies.importer")

    return rule


def certificate_companies(t: Column, ls: Column) -> Column:
    """exporter and importer of a certificate, from one pass over its lines."""

    def both(cands: Column) -> Column:
        return let(F.struct(cands.alias("cands"), F.coalesce(_first(F.filter(cands, lambda x: x.rlike(SUFFIX))), _first(cands)).alias("exporter")), importer)

    def importer(v: Column) -> Column:
        named = company_line(label(r"\bCONSIGNEE\b", value=r"[A-Za-z&]{3,}", reject=r"[0-9]{2}/[0-9]{2}/[0-9]{4}|\bconsignataire|consignat[aá]rio\b")(t, ls))
        named = let(named, lambda x: F.when(F.lower(x) != F.lower(v["exporter"]), x))
        return F.struct(v["exporter"].alias("exporter"), F.coalesce(named, _first(F.filter(v["cands"], lambda x: F.lower(x) != F.lower(v["exporter"])))).alias("importer"))

    return let(F.array_distinct(_companies(F.slice(ls, 1, 160))), both)


def phones(t: Column, ls: Column) -> Column:
    runs = F.filter(find_all(t, r"(\+?[0-9][0-9\s().\-]{7,}[0-9])"), lambda p: F.length(digits_only(p)).between(8, 16))
    return F.array_sort(F.array_distinct(F.transform(runs, collapse_spaces)))


def currency_export(t: Column, ls: Column) -> Column:
    near = label(r"\b(?:MONEDA|CURRENCY)\b", value=r"(US\$|USD|BRL|R\$|EUR|GBP|JPY|CNY|[A-Z]{3})", ahead=4)(t, ls)
    c = F.replace(F.upper(F.coalesce(near, find(t, r"(?i)\b(US\$|USD|BRL|R\$|EUR|GBP|JPY|CNY)\b"))), F.lit(" "), F.lit(""))
    return let(c, lambda x: F.when(x.isin("USD", "US$"), "US$").otherwise(x))


def doc_ref(labels: str) -> Rule:
    near = label(labels, value=r"[A-Z0-9][A-Z0-9\-/.]*[0-9][A-Z0-9\-/.]*", reject=r"[0-9]{2}/[0-9]{2}/[0-9]{4}", ahead=10)
    return lambda t, ls: F.coalesce(near(t, ls), find(t, r"\b(I-[0-9]{3,6}/[0-9]{2})\b"))


def kilos(pick: Callable[[Column], Column]) -> Rule:
    def rule(t: Column, ls: Column) -> Column:
        every = F.filter(F.transform(find_all(t, r"(?i)([0-9.,]+)\s*KGS\b", 1), parse_number_export), lambda v: v.isNotNull())
        return let(every, lambda all_: F.when(F.size(all_) >= 2, pick(all_)))

    return rule


def container_rows(t: Column, ls: Column) -> Column:
    """Container numbers with seal and two values; the first row of a number counts.

    A number stands with its seal on one line, or alone above seal and values
    within the next seven lines, up to the next number.
    """
    inline = r"^(?:[0-9]+\s+)?([A-Z]{4}[0-9]{7})\s+([A-Z0-9]{6,10})(?:\s+(.*))?$"
    alone = r"^[A-Z]{4}[0-9]{7}$"
    nums = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"[0-9][0-9.,]*"), F.lit(0)), parse_number_export), lambda v: v.isNotNull())

    def stacked(i: Column) -> Column:
        """Seal and values of the lines below."""
        near = F.slice(ls, i + 2, F.lit(7))
        stop = lambda v: F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), lambda k: F.coalesce(F.get(v, k).rlike(alone), F.lit(False))), F.lit(0))
        is_seal = lambda x: x.rlike("^[A-Z0-9]{6,10}$") & ~x.rlike("^[0-9]+$")
        below = let(near, lambda v: F.slice(v, F.lit(1), F.coalesce(stop(v), F.size(v))))
        sealed = let(below, lambda v: F.struct(v.alias("below"), _first(F.filter(v, is_seal)).alias("seal")))
        return let(sealed, lambda v: F.struct(v["seal"].alias("seal"), nums(F.array_join(F.filter(v["below"], lambda x: ~x.eqNullSafe(v["seal"])), " ")).alias("values")))

    def row(i: Column) -> Column:
        line = F.get(ls, i)
        one = line.rlike(inline)
        own = F.struct(F.regexp_extract(line, inline, 2).alias("seal"), nums(F.regexp_extract(line, inline, 3)).alias("values"))
        number_ = F.when(one, F.regexp_extract(line, inline, 1)).otherwise(line)
        return let(F.when(one, own).otherwise(stacked(i)), lambda v: F.struct(number_.alias("container_number"), v["seal"].alias("seal"), F.get(v["values"], F.lit(0)).alias("value_1"), F.get(v["values"], F.lit(1)).alias("value_2")))

    rows = F.transform(_indexes(ls, f"{inline}|{alone}"), row)
    ids = lambda r: r["container_number"]
    return let(rows, lambda rs: let(F.transform(rs, ids), lambda names: F.filter(rs, lambda r, i: F.array_position(names, r["container_number"]) == i + 1)))


def di_invoices(t: Column, ls: Column) -> Column:
    """References on invoice lines: with a digit, pure digits from four on, distinct in order."""
    near = F.filter(ls, lambda x: x.rlike(r"(?i)FATURA\s+COMERCIAL|\bINVOICE\b"))
    tokens = F.flatten(F.transform(near, lambda x: F.regexp_extract_all(F.regexp_replace(x, r"(?i)^.*?(?:FATURA\s+COMERCIAL|\bINVOICE\b)(?:\s*(?:NO|NR)\.?)?", ""), F.lit(r"[A-Z0-9][A-Z0-9\-/]*[0-9][A-Z0-9\-/]*"), F.lit(0))))
    return F.array_distinct(F.filter(tokens, lambda x: ~x.rlike("^[0-9]{1,3}$")))


@dataclass(frozen=True)
class Labelled:
    """A label rule as data: which label gives which field, and what its value may be.

    `colon` labels are found without accents or case anywhere on a line and
    have their value behind its first colon; others are patterns with the value
    behind them. Without one the next three lines are looked at.
    """

    field: str
    label: str
    digit: bool = False
    colon: bool = True
    #: Lines that are looked at: all, or those of a section of this heading.
    section: str = "all"
    #: What an inline value must have, and lines below that are none.
    must: str = "."
    skip: bool = False


# Headings of sections.
IMPORTER, EXPORTER_SECTION = "INFORMACOES - IMPORTADOR", "EXPORTADOR / FABRICANTE / PRODUTOR"
# Labels of declarations and licences.
_ALNUM = "[A-Za-z0-9]"
DI_LABELS = [
    *[Labelled(f, lab, digit, colon=False, must=_ALNUM) for f, lab, digit in (("reference_internal", r"NOSSA\s+REFER[ÊE]NCIA", False), ("reference_client", r"SUA\s+REFER[ÊE]NCIA", False), ("bl_number", "CONHECIMENTO", True), ("transport_mode", r"VIA\s+TRANSPORTE", False), ("port_of_loading", r"LOCAL\s+DE\s+EMBARQUE", False), ("shipment_date", r"DATA\s+DE\s+EMBARQUE", False), ("arrival_date", r"DATA\s+DE\s+CHEGADA", False))],
    *[Labelled(f, lab, digit) for f, lab, digit in (("declaration_type", "TIPO DE DECLARACAO", False), ("operational_unit", "UNIDADE OPERACIONAL", False), ("dispatch_urf", "URF DESPACHO", True), ("dispatch_modality", "MODALIDADE DESP", False), ("transport_carrier", "TRANSPORTADOR", False), ("entry_urf", "URF DE ENTRADA", True), ("country_of_provenance", "PAIS DE PROCED", True))],
    *[Labelled(f, lab, digit, section="importer") for f, lab, digit in (("importer_address", "ENDERECO IMPORTADOR", False), ("importer_number", "NUMERO", True), ("importer_complement", "COMPLEMENTO", False), ("importer_neighborhood", "BAIRRO", False), ("importer_cep", "CEP", True), ("importer_city_uf", "CIDADE/UF", False), ("importer_country", "PAIS", False))],
]
LI_LABELS = [
    *[Labelled(f, lab, digit, colon=False, skip=True) for f, lab, digit in (("importer_named", r"NOME\s+DO\s+IMPORTADOR", False), ("li_number", r"NR\s+LI\b", True), ("li_reference", r"NREFERENCIA(?:\s+LI)?", True))],
    *[Labelled(f, lab, digit) for f, lab, digit in (("country_of_origin", "PAIS DE ORIGEM", False), ("country_of_provenance", "PAIS DE PROCEDENCIA", False), ("country_of_acquisition", "PAIS DE AQUISICAO", True), ("country_proc", "PAIS PROC", True), ("dispatch_urf", "URF DESPACHO", True), ("entry_urf", "URF ENTRADA", True), ("currency", "MOEDA NEGOCIADA", False), ("purchase_condition", "CONDICAO DE VENDA", False), ("unit_commercial", "UNIDADE COMERC", False))],
    *[Labelled(f, lab, digit, section="importer") for f, lab, digit in (("importer_address", "ENDERECO", False), ("importer_number", "NUMERO", True), ("importer_complement", "COMPLEMENTO", False), ("importer_city", "CIDADE", False), ("importer_country", "PAIS", False))],
    *[Labelled(f, lab, section="exporter") for f, lab in (("exporter_address", "ENDERECO"), ("exporter_city", "CIDADE"), ("exporter_country", "PAIS"))],
]


def _sql(x) -> str:
    return str(x).lower() if isinstance(x, bool) else "r'" + x + "'"


def label_values(rules: list[Labelled], licence: bool) -> Rule:
    """field -> value of all label rules of a kind, by one expression over the rules as data: the plan does not grow with them.

    A licence's sections are at most 50 lines, end at a line with INFORMA and a
    dash, and are empty without their heading; a declaration's are at most 40,
    end at INFORMA, and are all lines then.
    """
    names = ("field", "label", "digit", "colon", "section", "must", "skip")
    rows = ", ".join("struct(" + ", ".join(f"{_sql(getattr(x, n))} AS {n}" for n in names) + ")" for x in rules)
    clean = lambda x: F.btrim(F.regexp_replace(strip(x), "^:+", ""))
    told = "(?i)" + "|".join(f"(?:{x.label})" for x in rules if not x.colon)
    named = "|".join(sorted({re.escape(x.label) for x in rules if x.colon}))

    def rule(t: Column, ls: Column) -> Column:
        def part(v: Column, heading: str) -> Column:
            head = _first(F.filter(F.sequence(F.lit(0), F.size(v["every"]) - 1), lambda k: F.get(v["every"], k)["plain"].contains(heading)))
            ends = lambda x: x["plain"].contains("INFORMA") & (x["line"].contains("-") if licence else F.lit(True))
            stop = lambda near: _first(F.filter(F.sequence(F.lit(0), F.size(near) - 1), lambda k: ends(F.get(near, k))))
            found = lambda near: F.when(F.size(near) > 0, F.slice(near, F.lit(1), F.coalesce(stop(near), F.size(near))))
            near = let(head, lambda h: F.when(h.isNotNull(), let(F.slice(v["every"], h + 2, F.lit(50 if licence else 40)), found)))
            near = F.coalesce(near, F.slice(v["every"], 1, 0))
            return near if licence else let(near, lambda n: F.when(F.size(n) > 0, n).otherwise(v["every"]))

        def values(p: Column) -> Column:
            return F.transform(F.expr(f"array({rows})"), lambda r: F.struct(r["field"].alias("field"), value(r, F.when(r["section"] == "importer", p["importer"]).when(r["section"] == "exporter", p["exporter"]).otherwise(p["all"])).alias("value")))

        def value(r: Column, src: Column) -> Column:
            digit = lambda x: ~r["digit"] | x.rlike("[0-9]")
            # Only lines that have the mark of any rule are looked at for a rule's own.
            marked = lambda e: F.when(r["colon"], e["plain"].contains(r["label"])).otherwise(e["told"] & F.rlike(e["line"], F.concat(F.lit("(?i)"), r["label"])))
            blank = lambda x: x.isin("", ":", "-", "--")

            def at(i: Column) -> Column:
                line = F.get(src["every"], i)["line"]
                behind = clean(F.when(r["colon"], F.regexp_replace(line, "^[^:]*:?", "")).otherwise(F.call_function("regexp_extract", line, F.concat(F.lit("(?i)"), r["label"], F.lit(r"\s*[:\-]?\s*(.+)$")), F.lit(1))))
                own = lambda x: ~blank(x) & digit(x) & ~(r["skip"] & F.when(r["colon"], F.upper(strip_accents(x)).contains(r["label"])).otherwise(F.rlike(x, F.concat(F.lit("(?i)"), r["label"]))))
                below = F.filter(F.transform(F.slice(src["every"], i + 2, F.lit(3)), lambda e: clean(e["line"])), own)
                fits = lambda x: (x != "") & (r["colon"] | ~blank(x)) & F.rlike(x, r["must"]) & digit(x)
                return let(behind, lambda x: F.when(fits(x), x).otherwise(_first(below)))

            places = F.filter(src["marks"], lambda i: F.coalesce(marked(F.get(src["every"], i)), F.lit(False)))
            return _first(F.filter(F.transform(places, at), lambda x: x.isNotNull()))

        def entries(v: Column) -> Column:
            parts = F.struct(v["every"].alias("all"), part(v, IMPORTER).alias("importer"), part(v, EXPORTER_SECTION).alias("exporter"))
            return let(parts, lambda p: F.map_from_entries(F.filter(let(F.struct(*[with_marks(p[n]).alias(n) for n in ("all", "importer", "exporter")]), values), lambda e: e["value"].isNotNull())))

        def with_marks(every: Column) -> Column:
            """Lines and the places of those that have the mark of any rule."""
            marks = F.filter(F.transform(every, lambda e, i: F.when(e["told"] | e["named"], i)), lambda i: i.isNotNull())
            return F.struct(every.alias("every"), marks.alias("marks"))

        def one(x: Column) -> Column:
            plain = F.upper(strip_accents(x))
            return let(plain, lambda p: F.struct(x.alias("line"), p.alias("plain"), x.rlike(told).alias("told"), p.rlike(named).alias("named")))

        return F.when(F.size(ls) > 0, let(F.struct(F.transform(ls, one).alias("every")), entries))

    return rule


def labelled(name: str, *patterns: str, table: str = "shared_labels") -> Rule:
    """The value that the label rules found for a field, else that of the first pattern."""
    own = lambda: F.try_element_at(table, F.lit(name))
    return lambda t, ls: F.coalesce(own(), find_any(t, patterns)) if patterns else own()


def licensed(name: str, *patterns: str) -> Rule:
    return labelled(name, *patterns, table="shared_licence")


def freight_terms(t: Column, ls: Column) -> Column:
    def at(i: Column) -> Column:
        return F.upper(F.coalesce(find(F.get(ls, i), r"(?i)\b(COLLECT|PREPAID)\b"), find(F.get(ls, i + 1), r"(?i)\b(COLLECT|PREPAID)\b")))

    return _first(F.filter(F.transform(_indexes(ls, r"(?i)\bFREIGHT\b"), at), lambda v: v.isNotNull()))


def bl_gross(t: Column, ls: Column) -> Column:
    """Within eight lines of the label: the sum of several weights on one line, else the largest."""
    i = _first(_indexes(ls, r"(?i)\bGROSS\s+WEIGHT\b"))
    near = F.transform(F.slice(ls, i + 1, F.lit(8)), lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"(?i)([0-9][0-9.,]+)\s*K\s*[G6S](?:S|M)?\b"), F.lit(1)), parse_number_import), lambda v: v.isNotNull()))
    several = lambda n: _first(F.filter(n, lambda v: F.size(v) > 1))
    return let(near, lambda n: F.coalesce(F.aggregate(several(n), F.lit(0.0), lambda a, v: a + v), F.array_max(F.flatten(n))))


def items_import(t: Column, ls: Column) -> Column:
    row = r"^\s*\*\s*([A-Z0-9]+)\s+([0-9]+)\s+UNITS?\s+@([0-9.,]+)\s*-\.\s+([0-9.,]+)\s*-\."
    return F.transform(
        F.filter(ls, lambda x: x.rlike(row)),
        lambda x: F.struct(F.regexp_extract(x, row, 1).alias("model"), F.regexp_extract(x, row, 2).cast("int").alias("qty"), parse_number_import(F.regexp_extract(x, row, 3)).alias("unit_price"), parse_number_import(F.regexp_extract(x, row, 4)).alias("amount")),
    )


# A table row `no packages CARTONS @net @gross m3 m3-total`, the mark of a model, words of lines that are no product.
ITEM_ROW = r"(?i)^([0-9]+(?:\s*-\s*[0-9]+)?)\s+([0-9]+)\s+CARTONS?\s+@[0-9.,]+\s+@[0-9.,]+\s+[0-9.,]+\s+([0-9.,]+)\s*$"
ITEM_MODEL = r"(?i)\*\s*MODEL\s*:\s*([A-Z0-9\-]+)"
NOT_A_PRODUCT = r"\b(PACKING|INVOICE|TOTAL|WEIGHT|VOLUME|BOX|CARTON|COMPANY|VAT|CNPJ)\b"
ITEM = "struct<model:string,no:string,packages:int,net_weight_kg:double,gross_weight_kg:double,m3_total:double,raw_line:string,raw_weights_line:string>"


def packing_items(t: Column, ls: Column) -> Column:
    """Rows of the table with the model above them and the weights on the line below, in one pass over the lines.

    Every line has a sign: M for a model, R for a row, o for others. A row takes
    the line below for its weights, whatever that is, so signs are read in
    pairs from a row on. Lines are then cut at the models, and the rows of each
    part get its model: no row looks back over the lines.
    """
    sign = lambda x: F.when(x.rlike(ITEM_MODEL), "M").when(x.rlike(ITEM_ROW), "R").otherwise("o")
    signs = F.split(F.regexp_replace(F.array_join(F.transform(ls, sign), ""), "R[MRo]", "Ro"), "")

    def item(i: Column, model: Column) -> Column:
        line, below = F.get(ls, i), F.get(ls, i + 1)
        numbers = F.regexp_extract_all(F.coalesce(below, F.lit("")), F.lit(r"[0-9][0-9.,]*"), F.lit(0))
        two = lambda k: F.when(F.size(numbers) >= 2, parse_number_import(F.get(numbers, F.lit(k))))
        return F.struct(
            model.alias("model"), F.btrim(F.regexp_replace(find(line, ITEM_ROW, 1), r"\s+", " ")).alias("no"), find(line, ITEM_ROW, 2).try_cast("int").alias("packages"),
            two(0).alias("net_weight_kg"), two(1).alias("gross_weight_kg"), parse_number_import(find(line, ITEM_ROW, 3)).alias("m3_total"), line.alias("raw_line"), below.alias("raw_weights_line"),
        )

    def parts(v: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(v["signs"]) - 1)
        marks = F.concat(F.array(F.lit(-1)), F.filter(every, lambda k: F.get(v["signs"], k) == "M"))
        return let(marks, lambda m: F.flatten(F.transform(m, lambda at, n: rows(v, at, F.coalesce(F.get(m, n + 1), F.size(v["signs"]))))))

    def rows(v: Column, at: Column, end: Column) -> Column:
        model = find(F.get(ls, at), ITEM_MODEL)
        part = F.slice(v["signs"], at + 2, end - at - 1)
        places = F.filter(F.transform(part, lambda x, k: F.when(x == "R", at + 1 + k)), lambda k: k.isNotNull())
        return F.transform(places, lambda i: item(i, model))

    found = let(F.struct(signs.alias("signs")), parts)
    return F.when(F.size(ls) > 0, found).otherwise(F.array().cast(f"array<{ITEM}>"))


def packing_totals(t: Column, ls: Column) -> Column:
    """The four totals that the list states, each null where it does not, found once as in draft_parties."""
    return let(F.struct(*[x.alias(n) for n, x in zip(("packages", "net", "gross", "m3"), (f(t, ls) for f in _PACKING_TOTALS), strict=True)]), lambda v: v)


def items_or_compact(t: Column, ls: Column) -> Column:
    """items, and whether they come from the totals: a first line of a product's code and text carries them, else a row named SUMMARY; nothing without totals."""
    total = F.col("shared_totals")
    some = F.coalesce(*[total[n].cast("string") for n in ("packages", "net", "gross", "m3")]).isNotNull()
    product = r"^\s*([A-Z0-9]{6,16})\s+(.+)$"
    fit = lambda x: x.rlike(product) & ~F.upper(x).rlike(NOT_A_PRODUCT) & (F.length(collapse_spaces(F.regexp_extract(x, product, 2))) >= 8)
    none = F.lit(None).cast("string")
    one = lambda model, line: F.struct(model.alias("model"), none.alias("no"), total["packages"].cast("int").alias("packages"), total["net"].alias("net_weight_kg"), total["gross"].alias("gross_weight_kg"), total["m3"].alias("m3_total"), line.alias("raw_line"), none.alias("raw_weights_line"))
    line = first_where(ls, fit)
    compact = let(line, lambda x: F.when(x.isNotNull(), F.array(one(F.regexp_extract(x, product, 1), x))).when(some, F.array(one(F.lit("SUMMARY"), F.lit("summary_from_totals")))))
    return F.when(F.size("shared_rows") > 0, F.struct(F.col("shared_rows").alias("items"), F.lit(False).alias("compact"))).otherwise(F.struct(F.coalesce(compact, F.array().cast(f"array<{ITEM}>")).alias("items"), compact.isNotNull().alias("compact")))


_NO = r"(?:NR\.?|NO\.?|N[Oº°.]?)"
_MODE, _LOAD, _DEST = r"\b(?:VIA\s+DE\s+TRANSPORTE|MEANS\s+OF\s+TRANSPORT)\b", r"\b(?:PUERTO\s+DE\s+EMBARQUE|PORT\s+OF\s+LOADING)\b", r"\b(?:PUERTO\s+DE\s+DESTINO|PORT\s+OF\s+(?:DESTINATION|DISCHARGE))\b"


def transport_values(t: Column, ls: Column) -> Column:
    """The values below three transport labels that stand in order; null where they don't."""
    marks = F.array(*[_indexes(ls, f"(?i){x}") for x in (_MODE, _LOAD, _DEST)])

    def values(m: Column) -> Column:
        a = _first(m[0])
        b = _first(F.filter(m[1], lambda i: i > a))
        c = _first(F.filter(m[2], lambda i: i > b))
        skip = f"(?i){_MODE}|{_LOAD}|{_DEST}|\\bPESO\\b|\\bWEIGHT\\b"
        vals = F.filter(F.transform(F.slice(ls, c + 2, F.lit(11)), clean_token), lambda v: v.isNotNull() & ~v.rlike(skip))
        return F.when((b > a) & (c > b), vals)

    return let(marks, values)


def stacked(which: int, own: str, ahead: int) -> Rule:
    """Three transport labels in order are followed by their three values; else each label has its own."""
    return lambda t, ls: F.coalesce(F.when(F.size("shared_transport") >= 3, F.get("shared_transport", F.lit(which))), label(own, ahead=ahead)(t, ls))


_PACKING_TOTALS = [
    lambda t, ls: parse_int_digits(total_packing(1, r"(?i)\bTOTAL\s+(?:BOXES|BOX|CARTONS?)\b.*?\b(?:NR\.?|N[Oº°.]?)\s*[:\-]?\s*([0-9]+)\b")(t, ls)),
    number(total_packing(2, r"(?i)\bNET(?:\s+WEIGHT)?\b[^0-9]{0,30}(?:TOTAL\s+)?(?:KILO|KGS?)\b[^0-9]{0,10}([0-9][0-9.,]*)\b"), parse_number_import),
    number(total_packing(3, r"(?i)\bGROSS(?:\s+WEIGHT)?\b[^0-9]{0,30}(?:TOTAL\s+)?(?:KILO|KGS?)\b[^0-9]{0,10}([0-9][0-9.,]*)\b"), parse_number_import),
    number(total_packing(4, r"(?i)\bTOTAL\s+VOLUME\b.*?\b(?:MC|M3)\b[^0-9]{0,10}([0-9][0-9.,]*)\b"), parse_number_import),
]
#: Columns that several rules of a kind use, computed once, in this order: a later one may use those before.
SHARED = {
    "exportation": {"shared_numbers": (bare_numbers, ("commercial_invoice", "packing_list")), "shared_transport": (transport_values, ("commercial_invoice",)), "shared_parties": (draft_parties, ("draft_bl",)), "shared_companies": (certificate_companies, ("certificate_of_origin",))},
    "importation": {"shared_labels": (label_values(DI_LABELS, False), ("di",)), "shared_licence": (label_values(LI_LABELS, True), ("li",)), "shared_weights": (invoice_weights, ("invoice",)), "shared_rows": (packing_items, ("packing_list",)), "shared_totals": (packing_totals, ("packing_list",)), "shared_items": (items_or_compact, ("packing_list",)), "shared_consignee": (consignee_block, ("bl", "hbl"))},
}


_BRUTO, _NETO = r"(?:\bPESO\s+BRUTO\b|\bGROSS\s+WEIGHT\b)", r"(?:\bPESO\s+NETO\b|\bNET\s+WEIGHT\b)"
_KG = r"\s*[:\-]?\s*([0-9][0-9.,]*)\s*(?:KGS?)?"
_P1 = parse_number_import
EXPORT: dict[str, list[tuple[str, bool, Rule]]] = {
    "commercial_invoice": [
        ("invoice_number", True, doc_ref(rf"(?:\bINVOICE\s*{_NO}\b|\bFATURA\b)")),
        ("invoice_date", True, pattern(DAY)),
        ("country_of_origin", True, label(r"\b(?:PA\S*\s+DE\s+ORIGEN|COUNTRY\s+OF\s+ORIGIN)\b", reject=r"\b(?:PARA|FECHA)\b", ahead=6)),
        ("transport_mode", True, stacked(0, _MODE, 8)),
        ("port_of_loading", True, stacked(1, _LOAD, 10)),
        ("port_of_destination", True, stacked(2, _DEST, 10)),
        ("gross_weight_kg", True, stacked_weight(0, _BRUTO)),
        ("net_weight_kg", True, stacked_weight(1, _NETO)),
        ("incoterm", True, incoterm_export),
        ("currency", True, currency_export),
        ("ncm", True, pattern(CODE)),
        ("container_count", True, lambda t, ls: parse_int_digits(find(t, r"(?i)\bCNTR\b[^0-9]{0,10}([0-9]+)"))),
        ("exporter_cnpj", True, cnpj_export),
        ("exporter_name", True, company_before_cnpj),
        ("importer_name", True, consignee),
        ("payment_terms", False, pattern(r"(?i)\b(COBRANZA[^\n\r]{3,120})", r"(?i)\b(PAYMENT\s+TERMS[^\n\r]*)")),
    ],
    "packing_list": [
        ("packing_list_number", True, doc_ref(rf"(?:\bPACKING\s*{_NO}\b|\bPACKING\s+LIST\b)")),
        ("packing_date", True, pattern(DAY)),
        ("gross_weight_kg", True, stacked_weight(0, _BRUTO)),
        ("net_weight_kg", True, stacked_weight(1, _NETO)),
        ("ncm", True, pattern(CODE)),
        ("incoterm", True, incoterm_export),
        ("container_count", True, lambda t, ls: parse_int_digits(find(t, r"(?i)\bCNTR\b[^0-9]{0,10}([0-9]+)"))),
        ("containers", True, container_rows),
    ],
    "draft_bl": [
        ("freight_mode", True, pattern(r"(?i)\bFREIGHT\b[^\n\r]{0,25}\b(COLLECT|PREPAID)\b")),
        ("incoterm", True, incoterm_export),
        ("ncm", True, pattern(r"(?i)\bNCM(?:/NALADI)?\b[:\s\-]*([0-9.]{4,})")),
        # Not required where the bill leaves it empty, see optional().
        ("due", True, lambda t, ls: clean_token(find(t, DUE))),
        ("ruc", True, pattern(r"(?i)\bRUC\b[:\s\-]*([A-Z0-9]+)")),
        ("booking_number", False, pattern(r"(?i)\b([A-Z]{3}[0-9]{7,})\b")),
        ("wooden_packing", True, pattern(r"(?i)\bWOODEN\s+PACKAGE\b[:\s\-]*([A-Z \/\-]+)")),
        ("total_cartons", True, lambda t, ls: parse_int_digits(find(t, r"(?i)\b([0-9.,]+)\s+CARTONS\b"))),
        ("net_weight_kg_total", True, weight(r"\bNET\s+WEIGHT\b", 6)),
        ("gross_weight_kg_total", True, weight(r"\bGROSS\s+WEIGHT\b", 6)),
        ("cubic_meters_total", True, number(pattern(r"(?i)\b([0-9.,]+)\s*(?:M3|CBM|M³)"))),
        ("exporter_cnpj", True, cnpj_export),
        ("exporter_name", True, lambda t, ls: F.col("shared_parties.exporter")),
        ("importer_name", True, lambda t, ls: F.col("shared_parties.importer")),
        ("notify_party_name", True, first_of(notify_by_mail, label(r"(?:\bNOTIFY\s+PARTY\b|\bALSO\s+NOTIFY\b|^NOTIFY\b)", reject=r"\b(?:PHONE|PORT|VESSEL)\b", ahead=12))),
        ("phones_found", False, phones),
        ("containers", True, container_rows),
    ],
    "certificate_of_origin": [
        ("invoice_number", True, doc_ref(r"\b(?:INVOICE|FACTURA|FATURA)\s+N(?:[RO]\b)?\.?")),
        ("certificate_date", True, pattern(DAY)),
        ("transport_mode", True, first_of(pattern(r"(?i)\b(BY\s+SEA|MARITIME|MARITIMO)\b"), label(r"\bMEANS\s+OF\s+TRANSPORT\b"))),
        ("exporter_name", True, certificate_company(0)),
        ("importer_name", True, certificate_company(1)),
        ("net_weight_kg", True, kilos(F.array_min)),
        ("gross_weight_kg", True, kilos(F.array_max)),
        ("total_m2", True, number(pattern(r"(?i)([0-9.,]+)\s*(?:M2|M²)"))),
    ],
    "container_data": [
        ("invoice_number", True, doc_ref(r"\b(?:FATURA|INVOICE)\b")),
        ("booking_number", True, first_of(label(r"\bBOOKING\b", value=r"[A-Z]{3}[0-9]{4,}", ahead=4), pattern(r"\b([A-Z]{3}[0-9]{4,})\b"))),
        ("containers", True, container_rows),
    ],
}
_NCM_IMPORT = pattern(r"(?i)\bNCM\b\s*(?:NO\.?|Nº)?\s*:?\s*([0-9]{4,8})")
_COUNTRY = lambda what: pattern(rf"(?im)^\s*COUNTRY\s+OF\s+{what}\s*[:\-]?\s*([A-Z][A-Z ]{{2,40}})\s*$")
_BL = [
    ("shipper_name", True, shipper_bl),
    *[(f, True, lambda t, ls: F.col("shared_consignee.name")) for f in ("importer_name", "consignee_name")],
    *[(f, True, lambda t, ls: F.col("shared_consignee.cnpj")) for f in ("importer_cnpj", "consignee_cnpj")],
    *[(f, True, _NCM_IMPORT) for f in ("ncm", "ncm_or_hs")],
    ("gross_weight_kg", True, bl_gross),
    *[(f, False, freight_terms) for f in ("freight_terms", "freight_term")],
    ("measurement_m3", False, number(pattern(r"(?i)([0-9][0-9.,]+)\s*(?:M3|CBM)\b"), _P1)),
    ("notify_party", False, lambda t, ls: company_line(label(r"\bNOTIFY(?:\s+PARTY)?\b", reject=r"\b(?:SHIPPER|BOOKING|B/L|PORT)\b", ahead=5)(t, ls))),
    ("port_of_loading", False, port("LOADING", vessel=True)),
    ("port_of_discharge", False, port("DISCHARGE")),
]
IMPORT: dict[str, list[tuple[str, bool, Rule]]] = {
    "invoice": [
        ("invoice_number", True, invoice_number_import),
        ("invoice_date", True, pattern(r"(?i)\b(?:DATA|DATE)\b\s*[:\-]?\s*([0-3]?[0-9]/[01]?[0-9]/(?:19|20)[0-9]{2})\b", r"(?i)\b((?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\.?\s+[0-9]{1,2},\s*[0-9]{4})\b", r"\b([0-3]?[0-9]/[01]?[0-9]/(?:19|20)[0-9]{2})\b")),
        ("payment_terms", True, pattern(r"(?i)\b(?:PAYMENT\s+TERMS|CONDIZIONI\s+DI\s+PAGAMENTO)\b[^\n\r]*[\r\n]+([^\n\r]{3,120})", r"(?i)\b(ADVANCE\s+PAYMENT)\b")),
        ("importer_name", True, first_of(lambda t, ls: _first(F.filter(_companies_import(F.slice(ls, _first(_indexes(ls, r"(?i)\bBILL\s*TO\b")) + 2, F.lit(15))), lambda x: ~x.rlike("^[A-Z]?[0-9]{2,}$"))), line_before_cnpj, beside_tax_label)),
        *[(f, True, cnpj_import) for f in ("importer_cnpj", "consignee_cnpj")],
        ("shipper_name", True, shipper_invoice),
        ("currency", True, lambda t, ls: F.coalesce(find(t, r"(?i)\bCURRENCY\b\s*[:\-]?\s*([A-Z]{3})\b"), find(t, r"(?i)\b(EUR|USD|BRL|JPY|CNY|GBP|CHF)\b"), F.when(t.contains("€"), "EUR"))),
        ("incoterm", True, incoterm_import),
        ("country_of_origin", False, _COUNTRY("ORIGIN")),
        ("country_of_acquisition", False, _COUNTRY("ACQUISITION")),
        ("country_of_provenance", False, _COUNTRY("PROVENANCE")),
        ("net_weight_kg", True, lambda t, ls: F.coalesce("shared_weights.net", "shared_weights.gross", "shared_weights.one")),
        ("gross_weight_kg", True, lambda t, ls: F.coalesce("shared_weights.gross", "shared_weights.net", "shared_weights.one")),
        ("total_quantity", False, number(pattern(r"(?i)\bTOTAL\s+(?:QTY|QUANTITY|UNITS)\b\s*[:\-]?\s*([0-9.,]+)\b"), _P1)),
        ("freight_and_expenses", False, lambda t, ls: t.rlike(r"(?i)\b(FREIGHT|INSURANCE|CHARGES?|EXPENSES?)\b")),
        ("line_items", False, items_import),
    ],
    "packing_list": [
        ("invoice_number", True, first_of(pattern(r"(?i)\bINVOICE\b[^\n]*?\b(?:NR\.?|NO\.?|NUMBER|N[Oº°.]?)\b[^0-9\n]*(?:INVOICE[_\-\s]*EXT\s*)?([0-9]{1,10})\b", r"(?i)\bINVOICE[_\-\s]*EXT\s*([0-9]{1,10})\b"), lambda t, ls: find(_first(F.filter(ls, lambda x: x.rlike("(?i)PACKING") & x.rlike(r"\b[A-Z]{1,4}-[0-9]{3,10}"))), r"\b([A-Z]{1,4}-[0-9]{3,10}(?:-[A-Z])?)\b"), pattern(r"\b([A-Z]{1,4}-[0-9]{3,10}(?:-[A-Z])?)\b"))),
        ("importer_name", True, lambda t, ls: clean_company(first_of(company_before_cnpj, lambda t, ls: company_line(label(r"\bACCOUNT\s+OF\b", ahead=5)(t, ls)))(t, ls), packing=True)),
        ("importer_cnpj", True, cnpj_import),
        ("shipper_name", False, lambda t, ls: company_line(label(r"\b(?:SHIPPER|EXPORTER)\b", ahead=5)(t, ls))),
        ("packages_total", True, or_sum("packages", "packages")),
        ("net_weight_kg", True, or_sum("net_weight_kg", "net")),
        ("gross_weight_kg", True, or_sum("gross_weight_kg", "gross")),
        ("measurement_total_m3", True, or_sum("m3_total", "m3")),
        ("items", True, lambda t, ls: F.col("shared_items.items")),
    ],
    "bl": _BL,
    "hbl": _BL,
    "di": [
        ("importer_name", True, first_of(label(r"^IMPORTADOR\b", value="[A-Za-z]{3}", ahead=5), company_before_cnpj)),
        ("importer_cnpj", True, cnpj_import),
        ("invoice_numbers", True, di_invoices),
        ("invoice_number", False, lambda t, ls: _first(di_invoices(t, ls))),
        ("net_weight_kg", False, number(pattern(r"(?i)\b(?:PESO\s+L[IÍ]QUIDO|NET\s+WEIGHT)\b" + _KG), _P1)),
        ("gross_weight_kg", False, number(pattern(r"(?i)\b(?:PESO\s+BRUTO|GROSS\s+WEIGHT)\b" + _KG), _P1)),
        *[(f, False, _NCM_IMPORT) for f in ("ncm", "ncm_or_hs")],
        ("di_number", False, pattern(r"(?i)\bDI\s*(?:NO|NR)?\.?\s*[:\-]?\s*([0-9]{2}/[0-9\-]+|[0-9]{6,})")),
        *[(x.field, False, labelled(x.field)) for x in DI_LABELS],
    ],
    "li": [
        ("importer_name", True, first_of(licensed("importer_named"), label(r"^IMPORTADOR\b", value="[A-Za-z]{3}", ahead=5), company_before_cnpj)),
        ("importer_cnpj", True, cnpj_import),
        ("li_number", False, licensed("li_number", r"(?is)\bLI\b\s*(?:NO\.?|Nº|NUMERO|NR)?\.?\s*[:\-]?\s*([0-9]{2}/[0-9\-]+|[0-9]{6,})")),
        ("li_reference", False, licensed("li_reference")),
        ("invoice_number", False, pattern(r"(?i)\b(?:INVOICE|FATURA)\s*(?:NO|NR|N)?\.?\s*[:\-]?\s*([A-Z0-9\-/]*[0-9][A-Z0-9\-/]*)")),
        ("net_weight_kg", False, number(pattern(r"(?i)\b(?:PESO\s+L[IÍ]QUIDO|NET\s+WEIGHT)\b" + _KG), _P1)),
        ("gross_weight_kg", False, number(pattern(r"(?i)\b(?:PESO\s+BRUTO|GROSS\s+WEIGHT)\b" + _KG), _P1)),
        ("quantity", False, number(pattern(r"(?is)\bQUANT\s+MEDIDA\s+ESTAT\b\s*[:\-]?\s*([0-9.,]+)", r"(?i)\bQUANTIDADE\b[^0-9\n]{0,30}([0-9.,]+)"), _P1)),
        *[(f, False, _NCM_IMPORT) for f in ("ncm", "ncm_or_hs")],
        ("country_of_origin", False, licensed("country_of_origin", r"(?is)\bPA[IÍ]S\s+DE\s+ORIGEM\b\s*[:\-]?\s*([A-Z][A-Z \-]{2,})")),
        ("country_of_provenance", False, licensed("country_of_provenance", r"(?is)\bPA[IÍ]S\s+DE\s+PROCED[ÊE]NCIA\b\s*[:\-]?\s*([A-Z][A-Z \-]{2,})")),
        ("country_of_acquisition", False, licensed("country_of_acquisition", r"(?is)\bPA[IÍ]S\s+DE\s+AQUISI[ÇC][ÃA]O\b\s*[:\-]?\s*([A-Z0-9 \-]+)")),
        ("country_proc", False, licensed("country_proc", r"(?is)\bPA[IÍ]S\s+PROC\b\s*[:\-]?\s*([A-Z0-9 \-]+)")),
        *[(f, False, licensed(f)) for f in ("dispatch_urf", "entry_urf", "currency", "purchase_condition", "unit_commercial")],
        ("exporter_name", False, label(r"^EXPORTADOR\b", reject=r"\b(?:FABRICANTE|PRODUTOR)\b", ahead=4)),
        ("unit_measure", False, pattern(r"(?is)\bUNID\s+MEDIDA\s+ESTAT\b\s*[:\-]?\s*([A-Z ]{2,})", r"(?i)\bUNIDADE\s+(?:DE\s+)?MEDIDA\b\s*[:\-]?\s*([^\n\r]+)")),
        ("incoterm", False, incoterm_import),
        *[(x.field, False, licensed(x.field)) for x in LI_LABELS if x.section != "all"],
    ],
}


# Further marks of declarations and licences, that are looked for where a model reads them.
MODEL_MARKS = {"di": r"|DECLARA\w*\s+DE\s+IMPORTA|\bN\w*MERO\s+DA\s+DI\b", "li": r"|LICEN[CÇ]A\s+DE\s+IMPORTA|\bN\w*MERO\s+DA\s+LI\b"}


def detect_kind_import(t: Column, model: bool = False) -> Column:
    more = MODEL_MARKS if model else {"di": "", "li": ""}
    return let(F.upper(t), lambda u: (
        F.when(u.rlike(r"\bHBL\b|HOUSE\s+BILL"), "hbl").when(u.rlike(r"PACKING\s+LIST|\bROMANEIO\b"), "packing_list")
        .when(u.rlike(r"(?U)CONFERENCIA\s+DI|RASCUNHO\s+(?:DA\s+)?DI|\bNR\.?\s*DI\b" + more["di"]), "di")
        .when(u.rlike(r"(?U)CONFERENCIA\s+LI|RASCUNHO\s+LI|\bNR\.?\s*LI\b|\bNREFERENCIA\s+LI\b" + more["li"]), "li")
        .when(u.rlike(r"INVOICE|PRO[-\s]?FORMA|FATTURA"), "invoice").when(u.rlike(r"BILL\s+OF\s+LADING|\bB/L\b|\bBL\b"), "bl").otherwise("unknown")
    ))


def infer_kind_export(name: Column, t: Column) -> Column:
    f = F.lower(F.coalesce(name, F.lit("")))
    has = lambda x, *words: F.greatest(*[x.contains(w) for w in words]) if len(words) > 1 else x.contains(words[0])
    return let(F.lower(collapse_spaces(t)), lambda u: (
        F.when(has(u, "certificate of origin", "certificado de origem"), "certificate_of_origin")
        .when(has(u, "bill of lading", "b/l number") | (has(u, "carrier") & has(u, "freight")), "draft_bl")
        .when(has(f, "packing") | has(u, "packing list"), "packing_list").when(has(f, "invoice") | has(u, "invoice"), "commercial_invoice")
        .when(has(f, "dados cntr") | (has(u, "booking") & has(u, "container")), "container_data").otherwise("unknown")
    ))


def hint_kind(hint: Column, flow: str) -> Column:
    """The kind that a hint means, null for one unknown to the flow."""
    names = HINTS_IMPORT if flow == "importation" else HINTS_EXPORT
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(F.btrim(hint)))


def join_pages(pages: DataFrame, *by: str) -> DataFrame:
    """Page texts of a document in page order, stripped, empty ones left out, joined by an empty line."""
    said_ = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: strip(x["text"])), lambda x: x != "")
    return pages.groupBy(*by).agg(F.array_join(said_, "\n\n").alias("text"))


def _front(t: Column) -> Column:
    return F.get(F.split(t, r"(?i)\bCONDITIONS OF CARRIAGE\b"), F.lit(0))


def deal(docs: DataFrame, *keys: str) -> DataFrame:
    """docs dealt by key over all cores: work on texts must not inherit the partitions of a small table.

    The number is given, as adaptive execution would join partitions that are
    small in bytes although each row costs much. Where tables are large,
    spark.sql.shuffle.partitions sets it.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return docs.repartition(n, *keys)


def docs_columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def rules_of(flow: str, kind: str, names: Collection[str] | None = None) -> list[tuple[str, bool, Rule]]:
    """The table of a kind, or its lines for the fields of these names."""
    table = (EXPORT if flow != "importation" else IMPORT)[kind]
    return table if names is None else [line for line in table if line[0] in names]


def extract_kind(docs: DataFrame, flow: str, kind: str, with_lines: bool = False, names: Collection[str] | None = None) -> DataFrame:
    """(…, text) of one kind -> its columns and one column per field, or per field of these names; with_lines: and warnings (of all fields alone) and the lines."""
    export = flow != "importation"
    text = _front(F.col("text")) if kind == "draft_bl" else F.col("text")
    text = text if export else normalize_spaces(text)
    d = docs.withColumn("text", text)
    # The windows of an import invoice count its empty lines.
    d = d.withColumn("lines", lines_collapsed("text") if export else lines("text", keep_empty=kind == "invoice"))
    t, ls = F.col("text"), F.col("lines")
    later = ("shared_items",)
    shared = {name: rule for name, (rule, kinds) in SHARED["exportation" if export else "importation"].items() if kind in kinds}
    for part in ([n for n in shared if n not in later], [n for n in shared if n in later]):
        if part:
            d = d.withColumns({n: shared[n](t, ls) for n in part})
    more = [*([] if names is not None else [warnings(flow, kind).alias("warnings")]), F.col("lines")] if with_lines else []
    # Fields of the same rule have one value, found once.
    fields, first = rules_of(flow, kind, names), {}
    for f, _, rule in fields:
        first.setdefault(id(rule), (f, rule))
    out = d.select(*docs_columns(docs), *[rule(t, ls).alias(f) for f, rule in first.values()], *more)
    if len(first) < len(fields):
        out = out.select(*docs_columns(docs), *[F.col(first[id(rule)][0]).alias(f) for f, _, rule in fields], *[c for c in ("warnings", "lines") if c in out.columns])
    if with_lines:
        # A generator between: what follows uses a field several times, and the optimizer would put its rule in for each use.
        out = out.select(F.explode(F.array(F.struct(*[F.col(c) for c in out.columns]))).alias("row")).select("row.*")
    return out


def warnings(flow: str, kind: str) -> Column:
    """What a kind's rules have to say of their own inferences, over its shared columns."""
    no = F.lit(None).cast("string")
    said = [no]
    if (flow, kind) == ("importation", "invoice"):
        w = F.col("shared_weights")
        said = [F.when(w["one"].isNotNull(), "invoice_single_weight_used_for_net_and_gross"), F.when(w["net"].isNull() & w["gross"].isNotNull(), "invoice_net_weight_inferred_from_gross"), F.when(w["gross"].isNull() & w["net"].isNotNull(), "invoice_gross_weight_inferred_from_net")]
    if (flow, kind) == ("importation", "packing_list"):
        volume = F.exists("lines", lambda x: x.rlike(r"(?i)\bTOTAL\s+VOLUME\b.*\b(?:MC|M3)\b"))
        said = [F.when(F.col("shared_items.compact"), "packing_items_compact_fallback_used"), F.when(F.col("shared_totals.m3").isNull() & volume, "packing_total_volume_found_without_numeric_value")]
    if (flow, kind) == ("exportation", "draft_bl"):
        said = [F.when(empty_due(F.col("text")), 'DUE appears empty (example: "DUE: .") and was treated as missing.')]
    return F.array_compact(F.array(*said))


# The codes of tariffs have so many digits.
NCM_DIGITS = (4, 6, 8)
DUE = r"(?i)\bDUE\b[:\s\-]*([A-Z0-9.\-/]+)"


def empty_due(t: Column) -> Column:
    """Whether a bill names its DUE but says nothing behind it."""
    return F.coalesce(find(t, DUE).isNotNull() & clean_token(find(t, DUE)).isNull(), F.lit(False))


def row_warnings(flow: str, kind: str) -> Column:
    """Warnings that compare the fields of an extracted row."""
    said = [F.lit(None).cast("string")]
    if (flow, kind) == ("importation", "packing_list"):
        for field, name in (("net_weight_kg", "Net Weight"), ("gross_weight_kg", "Gross Weight")):
            total = F.aggregate(F.filter(F.col(f"items.{field}"), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
            text = F.format_string(f"Soma {name} da tabela (%.2f) difere do TOTAL (%.2f). Usando TOTAL.", total, F.col(field))
            said.append(F.when((F.size("items") > 0) & (F.abs(total - F.col(field)) > 0.5), text))
    if flow == "importation" and kind in ("bl", "hbl", "di", "li"):
        n = F.length("ncm")
        said.append(F.when(F.col("ncm").isNotNull() & ~n.isin(*NCM_DIGITS), F.concat(F.lit("NCM/HS com "), n.cast("string"), F.lit(" digitos ("), "ncm", F.lit("). Verificar."))))
    if (flow, kind) == ("exportation", "draft_bl"):
        want = expected_freight(F.col("incoterm"), True)
        text = F.concat(F.lit("possible_incoterm_freight_mismatch: incoterm="), "incoterm", F.lit(" expected="), want, F.lit(" freight_mode="), "freight_mode")
        said.append(F.when(F.upper("freight_mode") != want, text))
    return F.array_compact(F.array(*said))


def optional(flow: str, kind: str) -> dict[str, str]:
    """Required fields that an extracted row may lack all the same, by an expression over its warnings."""
    if (flow, kind) == ("exportation", "draft_bl"):
        return {"due": "exists(warnings, w -> startswith(w, 'DUE appears empty'))"}
    return {}


def missing_required(fields: DataFrame, flow: str, kind: str) -> Column:
    """Names of the required fields that are null, empty or an empty list, in the order of the kind.

    Where fields have their warnings, those that a warning makes optional are left out.
    """
    spared = optional(flow, kind) if "warnings" in fields.columns else {}
    out = []
    for f, required, _ in (EXPORT if flow != "importation" else IMPORT)[kind]:
        if required:
            lacks = F.col(f).isNull()
            kind_ = dict(fields.dtypes)[f]
            lacks = lacks | (F.size(f) == 0) if kind_.startswith("array") else lacks | (F.btrim(f) == "") if kind_ == "string" else lacks
            out.append(F.when(lacks & ~F.expr(spared[f]) if f in spared else lacks, F.lit(f)))
    return F.array_compact(F.array(*out))
