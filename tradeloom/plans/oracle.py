"""DuckDB SQL of the functions, written apart from the Spark expressions; for the oracle queries only."""

from __future__ import annotations

from ..functions.compare import FREIGHT, FREIGHT_EXPORT, INCOTERMS, SHIPPER_WORDS
from ..operators.checks import EXPORT_SPECS, FAMILIES, IMPORT_SPECS
from .trade import SQL as TRADE


def bare(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9,.-]', '', 'g')"


def _right_most(s: str) -> str:
    return f"CASE WHEN instr(reverse({s}), ',') < instr(reverse({s}), '.') THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '') END"


def _last(s: str, c: str) -> str:
    q = f"string_split({s}, '{c}')"
    return f"array_to_string({q}[1:len({q}) - 1], '') || '.' || {q}[len({q})]"


def number(parser: str, x: str) -> str:
    s = bare(x)
    both = f"WHEN contains({s}, ',') AND contains({s}, '.') THEN {_right_most(s)}"
    if parser == "p1":
        body = rf"{both} WHEN contains({s}, ',') THEN CASE WHEN regexp_full_match({s}, '-?[0-9]{{1,3}}(,[0-9]{{3}})+') THEN replace({s}, ',', '') ELSE replace({s}, ',', '.') END WHEN regexp_full_match({s}, '-?[0-9]{{1,3}}(\.[0-9]{{3}}){{2,}}') THEN replace({s}, '.', '')"
    elif parser == "p2":
        body = f"{both} WHEN contains({s}, ',') THEN CASE WHEN len({s}) - len(replace({s}, ',', '')) > 1 THEN {_last(s, ',')} ELSE replace({s}, ',', '.') END WHEN len({s}) - len(replace({s}, '.', '')) > 1 THEN {_last(s, '.')}"
    elif parser == "p4":
        body = f"{both} WHEN contains({s}, ',') THEN replace({s}, ',', '.') WHEN len({s}) - len(replace({s}, '.', '')) > 1 THEN {_last(s, '.')}"
    else:
        lone = lambda c: rf"regexp_extract({s}, '^([^{c}]*)[{c}](.*)$', 1), regexp_extract({s}, '^([^{c}]*)[{c}](.*)$', 2)"
        l1, r1 = lone(",").split(", r", 1)
        l2, r2 = lone(".").split(", r", 1)
        body = rf"""WHEN regexp_full_match({s}, '-?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?') THEN replace({s}, ',', '')
          WHEN regexp_full_match({s}, '-?[0-9]{{1,3}}(\.[0-9]{{3}})+(,[0-9]+)?') THEN replace(replace({s}, '.', ''), ',', '.')
          {both} WHEN contains({s}, ',') THEN CASE WHEN len(r{r1}) = 3 AND len({l1}) <= 3 THEN {l1} || r{r1} ELSE {l1} || '.' || r{r1} END
          WHEN contains({s}, '.') AND len(r{r2}) = 3 AND len({l2}) <= 3 THEN {l2} || r{r2}"""
    return f"TRY_CAST(CASE {body} ELSE {s} END AS DOUBLE)"


def norm(x: str, export: bool = False) -> str:
    s = f"upper(trim(coalesce({x}, '')))"
    if not export:
        s = f"replace({s}, 'Ç', 'C')"
    s = rf"regexp_replace(regexp_replace({s}, '\s+', ' ', 'g'), '[^A-Z0-9 ]+', '', 'g')"
    return f"trim({s})" if export else f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def string_close(a: str, b: str, export: bool = False) -> str:
    x, y = norm(a, export), norm(b, export)
    s, t = f"string_split({x}, ' ')", f"string_split({y}, ' ')"
    jac = f"len(list_intersect({s}, {t}))::DOUBLE / len(list_distinct(list_concat({s}, {t}))) >= 0.55"
    held = "" if export else f" OR contains({x}, {y}) OR contains({y}, {x})"
    return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR {jac}{held}))"


def docref(x: str, export: bool = False) -> str:
    return f"regexp_replace(nullif(regexp_replace({norm(x, export)}, '[^A-Z0-9]', '', 'g'), ''), '{'P+$' if export else 'P$'}', '')"


def docref_close(a: str, b: str, export: bool = False) -> str:
    return f"coalesce({docref(a, export)} = {docref(b, export)}, false)"


def cnpj_close(a: str, b: str) -> str:
    return f"({digits(a)} <> '' AND {digits(a)} = {digits(b)})"


def ncm_close(a: str, b: str) -> str:
    x, y = digits(a), digits(b)
    return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR (least(len({x}), len({y})) IN (4, 6) AND CASE WHEN len({x}) <= len({y}) THEN starts_with({y}, {x}) ELSE starts_with({x}, {y}) END)))"


def number_close(a: str, b: str, abs_tol: float = 1.0, rel_tol: float = 0.01) -> str:
    return f"(abs({a} - {b}) <= {abs_tol} OR abs({a} - {b}) / greatest(abs({a}), abs({b}), 1.0) <= {rel_tol})"


def shipper_close(a: str, b: str) -> str:
    stop = ", ".join(f"'{w}'" for w in SHIPPER_WORDS + INCOTERMS)
    said = lambda v: f"list_filter(string_split({norm(v)}, ' '), lambda t: len(t) >= 4 AND t NOT IN ({stop}))"
    return f"({string_close(a, b)} OR len(list_intersect({said(a)}, {said(b)})) > 0)"


def freight(term: str, export: bool = False) -> str:
    return f"CASE {term} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (FREIGHT_EXPORT if export else FREIGHT).items()) + " END"


_GA, _GB = "round(net_a * 1.1, 3)", "round(net_b * 1.1, 3)"
#: Document kind -> field -> (text, number) over `trade`.
IMPORT_DOCS = {
    "invoice": {"invoice_number": ("inv_a", None), "importer_name": ("imp_a", None), "importer_cnpj": ("cnpj_a", None), "gross_weight_kg": (None, _GA), "net_weight_kg": (None, "net_a")},
    "packing": {"invoice_number": ("inv_b", None), "consignee_name": ("imp_b", None), "consignee_cnpj": ("cnpj_b", None), "gross_weight_kg": (None, _GB), "net_weight_kg": ("CASE WHEN k % 13 = 0 THEN 'n/a' END", "CASE WHEN k % 13 <> 0 THEN net_b END")},
    "bl": {"consignee_name": ("imp_b", None), "consignee_cnpj": ("cnpj_b", None), "gross_weight_kg": (None, _GB), "ncm": ("ncm_b", None)},
    "di": {"importer_name": ("imp_a", None), "importer_cnpj": ("cnpj_a", None), "invoice_numbers": ("inv_a", None), "ncm": ("ncm_a", None), "net_weight_kg": (None, "net_a")},
}
LICENCE = {"li": {"importer_name": ("imp_b", None), "importer_cnpj": ("cnpj_b", None), "invoice_number": ("inv_b", None), "ncm": ("ncm_b", None), "gross_weight_kg": (None, _GB)}}
_NO = "lpad(CAST(k % 10000000 AS VARCHAR), 7, '0')"
EXPORT_DOCS = {
    "invoice": {"invoice_number": ("inv_a", None), "importer_name": ("imp_a", None), "exporter_cnpj": ("cnpj_a", None), "exporter_name": ("exp_a", None), "incoterm": ("term", None), "gross_weight_kg": (None, _GA), "net_weight_kg": (None, "net_a"), "ncm": ("ncm_a", None), "container_count": (None, "containers::DOUBLE")},
    "packing": {"packing_list_number": ("inv_b", None), "incoterm": ("term", None), "gross_weight_kg": (None, _GB), "net_weight_kg": (None, "net_b"), "ncm": ("ncm_b", None), "container_count": (None, "(containers + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END)::DOUBLE")},
    "bl": {"importer_name": ("imp_b", None), "exporter_cnpj": ("cnpj_b", None), "exporter_name": ("exp_b", None), "incoterm": ("term", None), "gross_weight_kg_total": (None, _GB), "net_weight_kg_total": (None, "net_b"), "ncm": ("ncm_b", None), "booking_number": (f"CASE WHEN k % 9 = 0 THEN 'SSY' ELSE 'SSZ' END || {_NO}", None), "containers": (f"CASE WHEN k % 14 = 0 THEN NULL WHEN k % 10 = 0 THEN 'TEMU' || {_NO} ELSE 'MSKU0000001,TEMU' || {_NO} END", None)},
    "container": {"invoice_number": ("inv_a", None), "booking_number": (f"'SSZ' || {_NO}", None), "containers": (f"'MSKU0000001,TEMU' || {_NO}", None)},
    "coo": {"invoice_number": ("inv_b", None), "importer_name": ("imp_b", None), "exporter_name": ("exp_b", None), "gross_weight_kg": (None, _GB), "net_weight_kg": (None, "net_b")},
}


def _side(doc: dict, keys: list[str]) -> tuple[str, str]:
    have = [doc[k] for k in keys if k in doc]
    if not have:
        return "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
    text, num = [t for t, _ in have if t], [n for _, n in have if n]
    return f"coalesce({', '.join(text)}, NULL)" if text else "CAST(NULL AS VARCHAR)", f"coalesce({', '.join(num)}, NULL)" if num else "CAST(NULL AS DOUBLE)"


def checks(flow: str, licence: bool = False, of: dict | None = None) -> str:
    """Common table expressions ending in `checks` (k, family, a_role, b_role, check_ord, check, status, reason)."""
    export = flow != "importation"
    docs, specs = (EXPORT_DOCS, EXPORT_SPECS) if export else (IMPORT_DOCS | (LICENCE if licence else {}), IMPORT_SPECS)
    docs = of or docs
    rows = []
    for family, a, b in [("invoice_vs_packing", "invoice", "packing"), *FAMILIES[flow]]:
        if a not in docs or b not in docs:
            continue
        for i, (name, kind, ka, kb, *tol) in enumerate(specs[family]):
            (ta, na), (tb, nb) = _side(docs[a], ka), _side(docs[b], kb)
            ma, mb = f"({ta} IS NULL AND {na} IS NULL)", f"({tb} IS NULL AND {nb} IS NULL)"
            reason = f"WHEN {ma} AND {mb} THEN 'missing_on_both' WHEN {ma} THEN 'missing_on_a' WHEN {mb} THEN 'missing_on_b'"
            if kind == "number":
                p = "p4" if export else "p3"
                x, y = f"coalesce({na}, {number(p, ta)})", f"coalesce({nb}, {number(p, tb)})"
                reason += f" WHEN {x} IS NULL OR {y} IS NULL THEN 'not_numeric'"
                ok = number_close(x, y, *(tol or (1.0, 0.01)))
            elif kind == "string":
                ok = string_close(ta, tb, export)
            elif kind == "cnpj":
                ok = cnpj_close(ta, tb)
            elif kind == "container_set":
                ok = f"({ta} = {tb})"
            elif kind in ("docref", "docref_set"):
                ok = docref_close(ta, tb, export)
            else:
                ok = ncm_close(ta, tb)
            rows.append(f"SELECT k, '{family}' AS family, '{a}' AS a_role, '{b}' AS b_role, {i} AS check_ord, '{name}' AS \"check\", CASE {reason} END AS reason, {ok} AS ok FROM trade")
    every = " UNION ALL ".join(rows)
    return f"""{TRADE}, every AS ({every}),
checks AS (SELECT k, family, a_role, b_role, check_ord, "check", reason, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN ok THEN 'match' ELSE 'divergent' END AS status FROM every)"""
