"""Number parsers, comparators and extraction on cases worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import compare as C
from tradeloom.functions import numbers as N
from tradeloom.functions import text as T
from tradeloom.operators import extract as X
from tradeloom.sources import pages as P

NUMBERS = [
    ("7,980", 7980, 7.98, 7980, 7.98), ("9,825.000", 9825, 9825, 9825, 9825), ("5.009,00", 5009, 5009, 5009, 5009), ("53.772", 53.772, 53.772, 53772, 53.772),
    ("1.234.567", 1234567, 1234.567, 1234567, 1234.567), ("9825,000", 9825, 9825, 9825, 9825), ("53,772", 53772, 53.772, 53772, 53.772), ("1,5", 1.5, 1.5, 1.5, 1.5),
    ("-", None, None, None, None), ("1,234,567", 1234567, 1234.567, 1234567, None), ("1234,5,6", None, 12345.6, None, None), ("1.23.4", None, 123.4, None, 123.4),
    ("USD 1,234.50", 1234.5, 1234.5, 1234.5, 1234.5), ("", None, None, None, None), (None, None, None, None, None),
]


def test_numbers(spark):
    df = spark.createDataFrame([(x[0],) for x in NUMBERS], "s string")
    got = df.select("s", N.parse_number_import("s"), N.parse_number_export("s"), N.to_float_import("s"), N.to_float_export("s")).collect()
    assert [tuple(r) for r in got] == NUMBERS


CASES = [
    (C.string_close_import, "Açme  Ltda.", "ACME LTDA", True), (C.string_close_import, "ACME", "ACME DO BRASIL IMPORT LTDA", True), (C.string_close_export, "ACME", "ACME DO BRASIL IMPORT LTDA", False),
    (C.string_close_import, "---", "---", False), (C.string_close_import, None, "x", False), (C.cnpj_close, "03.562.381/0006-03", "03562381000603", True), (C.cnpj_close, "", "", False),
    (C.docref_close_import, "DN-24139", "DN-24139-P", True), (C.docref_close_import, "DN-24139", "DN-24139PP", False), (C.docref_close_export, "DN-24139", "DN-24139PP", True),
    (C.ncm_close, "8703.21.00", "8703", True), (C.ncm_close, "8703.21.00", "87032", False), (C.shipper_close, "SUZUKI MOTOR CORP", "THE SUZUKI GROUP OF JAPAN", True),
]


@pytest.mark.parametrize("f,a,b,want", CASES)
def test_comparators(spark, f, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(f(F.col("a"), F.col("b"))).collect()[0][0] is want


@pytest.fixture(scope="session")
def fixtures():
    import pathlib

    root = pathlib.Path(__file__).parents[1]
    return {m[1]: m[2] for m in re.finditer(r"\*\*(\w+ [A-Z ]+\.pdf)\*\*[^\n]*\n\n```text\n(.*?)\n```", (root / "FIXTURES.md").read_text(), re.S)}


def extract(spark, text, flow, kind):
    x = X.extract_kind(spark.createDataFrame([(text,)], "text string"), flow, kind)
    return x.select("*", X.missing_required(x, flow, kind).alias("missing")).collect()[0].asDict(recursive=True)


def test_export_invoice(spark, fixtures):
    r = extract(spark, fixtures["export COMMERCIAL INVOICE TEST.pdf"], "exportation", "commercial_invoice")
    want = {"invoice_number": "I-0007/25", "transport_mode": "INCOTERMS CFR", "port_of_loading": "CURRENCY USD", "currency": "US$", "container_count": 1, "exporter_cnpj": "03562381000603", "exporter_name": "CURRENCY USD", "importer_name": "CLIENTE TESTE SA", "missing": ["gross_weight_kg", "net_weight_kg"]}
    assert {k: r[k] for k in want} == want


def test_export_packing_and_bl(spark, fixtures):
    r = extract(spark, fixtures["export PACKING LIST TEST.pdf"], "exportation", "packing_list")
    assert r["packing_list_number"] == "NR I-0007/25" and r["missing"] == ["gross_weight_kg", "net_weight_kg"]
    assert r["containers"] == [{"container_number": "TEMU1680211", "seal": "M1024218", "value_1": 76.98, "value_2": None}]
    r = extract(spark, fixtures["export DRAFT BL TEST.pdf"], "exportation", "draft_bl")
    assert (r["net_weight_kg_total"], r["gross_weight_kg_total"], r["cubic_meters_total"], r["total_cartons"]) == (7980, 9825, 53.772, 12)
    assert r["exporter_name"] == "WOODEN PACKAGE: NO" and r["importer_name"] == "HOME THINGS LTDA" and r["notify_party_name"] == "CLIENTE TESTE SA" and not r["missing"]


def test_import(spark, fixtures):
    r = extract(spark, fixtures["import INVOICE.pdf"], "importation", "invoice")
    assert r["invoice_number"] == "INV-TEST-001" and r["importer_name"] == "INVOICE NO: INV-TEST-001" and r["shipper_name"] == "COMMERCIAL INVOICE"
    assert r["missing"] == ["invoice_date", "payment_terms", "currency", "net_weight_kg", "gross_weight_kg"]
    r = extract(spark, fixtures["import PACKING LIST.pdf"], "importation", "packing_list")
    assert r["invoice_number"] == "001" and r["missing"] == ["importer_name", "importer_cnpj", "packages_total", "net_weight_kg", "gross_weight_kg", "measurement_total_m3", "items"]
    r = extract(spark, fixtures["import BL.pdf"], "importation", "bl")
    assert r["shipper_name"] == "PORT OF LOADING: SANTOS" and (r["port_of_loading"], r["port_of_discharge"]) == ("SANTOS", "NAVEGANTES")
    assert r["missing"] == ["importer_name", "consignee_name", "importer_cnpj", "consignee_cnpj", "ncm", "ncm_or_hs", "gross_weight_kg"]


def test_kinds(spark, fixtures):
    df = spark.createDataFrame([(k, v) for k, v in fixtures.items()], "name string, text string")
    got = {r[0]: (r[1], r[2]) for r in df.select("name", X.detect_kind_import(F.col("text")), X.infer_kind_export(F.col("name"), F.col("text"))).collect()}
    assert [got[f"export {n} TEST.pdf"][1] for n in ("COMMERCIAL INVOICE", "PACKING LIST", "DRAFT BL")] == ["commercial_invoice", "packing_list", "draft_bl"]
    assert [got[f"import {n}.pdf"][0] for n in ("INVOICE", "PACKING LIST", "BL")] == ["invoice", "packing_list", "bl"]


def test_text(spark):
    df = spark.createDataFrame([(" a \t b\n\n\n\nc\0 ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.clean_text("t")).collect()] == ["a b\n\nc", None, ""]
    assert spark.range(1).select(T.strip_accents(F.lit("Ação É"))).collect()[0][0] == "Acao E"


def test_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one page of direct text" * 5 + b"\f" + b"short")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "names.json").write_text('﻿{"a.pdf": " Original.pdf ", "b.pdf": ""}')

    def read(content):
        if content == b"broken":
            raise ValueError("no PDF")
        return content.decode().split("\f")

    pages = P.extract_pages(P.read_pdfs(spark, str(tmp_path)), read)
    got = P.with_names(pages, P.read_side_car(spark, str(tmp_path / "names.json"))).orderBy("source_file", "page").collect()
    assert [(r["file"], r["page"], r["method"]) for r in got] == [("Original.pdf", 1, "direct"), ("Original.pdf", 2, "ocr_unavailable"), ("b.pdf", 1, "ocr_error")]
    assert P.page_counts(pages).where("source_file = 'a.pdf'").collect()[0].asDict()["direct"] == 1


def test_strip_and_accents_look_at_what_they_did(spark):
    edge = [*T.SPACES, "\x1c", "​", "﻿", "a", "é", ""]
    d = spark.createDataFrame([(a + b + "x y" + c,) for a in edge for b in edge for c in edge] + [(T.SPACES,), ("",), (None,)], "s string")
    old = {"strip": (T.strip("s"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "")), "accents": (T.strip_accents("s"), F.translate("s", T.ACCENTED, T.PLAIN)), "spaces": (T.normalize_spaces("s"), F.regexp_replace(F.translate("s", "\xa0", " "), r"[ \t]+", " "))}
    for name, (new, was) in old.items():
        assert d.where(~new.eqNullSafe(was)).count() == 0, name


@pytest.mark.parametrize("flow, kind, mark, most", [("exportation", "draft_bl", "INDUSTRIA", 1), ("exportation", "certificate_of_origin", "INDUSTRIA", 1), ("importation", "bl", "COLLECT|PREPAID", 4)])
def test_values_of_several_rules_are_found_once(spark, flow, kind, mark, most):
    """F20-F34: a struct was put in for each use of one of its parts, and rules of several fields for each field; a pattern stands in a search and its extraction."""
    x = X.extract_kind(spark.createDataFrame([(1, "a")], "k long, text string"), flow, kind)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(mark) <= most


def test_flow_deals_its_texts_once(spark):
    """F8, F11: the filter of each kind went below the exchange, so that texts were made and dealt for every kind."""
    from tradeloom.operators import flow as FL

    docs = spark.createDataFrame([(1, "a", "x.pdf", None, "packing list")], "run_id long, doc_id string, original_file string, hint string, text string")
    d = FL.extract_wide(docs, "exportation").select("doc_kind")
    assert d.collect()[0][0] == "packing_list"
    plan = d._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")]
    assert plan.count("ReusedExchange") == plan.count("Union") * 5


def test_resumed_checks_writes_no_check_rows(spark, monkeypatch):
    """F16: all check rows were written first, and never read."""
    from tradeloom.plans import result_queries as Q

    def stop(*_):
        raise KeyError("stage 02")

    monkeypatch.setattr(Q, "_rows", lambda *_: pytest.fail("check rows are not needed"))
    monkeypatch.setattr(Q, "written", lambda df: df)
    monkeypatch.setattr(Q.S, "write_stage02", stop)
    with pytest.raises(KeyError):
        Q.resumed_checks(spark, "/root/testdata/sf0.001")


def test_flow_finds_only_the_fields_that_are_read(spark):
    """F5-F10: kinds, evidence of one field and pair checks extracted every field of every document."""
    from tradeloom.operators import checks as K
    from tradeloom.operators import flow as FL

    text = "COMMERCIAL INVOICE\nINVOICE NO: INV-77\nCURRENCY: USD\nINCOTERM FOB\nNET WEIGHT: 10.00 KGS\nGROSS WEIGHT: 15.00 KGS"
    rows = [(1, "a", "x.pdf", None, text), (1, "b", "y.pdf", None, "PACKING LIST INV-77"), (1, "c", "z.pdf", None, "nothing")]
    docs = spark.createDataFrame(rows, "run_id long, doc_id string, original_file string, hint string, text string")
    read = K.fields_read("importation")
    whole = {(r.doc_id, f.field): (f.present, f.value_str, f.value_num, f.value_list, f.evidence) for r in FL.extract_wide(docs, "importation").collect() for f in r.fields or []}
    some = FL.extract_wide(docs, "importation", read).collect()
    got = {(r.doc_id, f.field): (f.present, f.value_str, f.value_num, f.value_list, f.evidence) for r in some for f in r.fields or []}
    assert got == {k: v for k, v in whole.items() if k[1] in read} and 0 < len(got) < len(whole)
    assert sorted(r.doc_id for r in some) == ["a", "b", "c"]
    assert [r.doc_id for r in FL.extract_wide(docs, "importation", ["invoice_number"], ["invoice"]).collect()] == ["a"]
    kinds = FL.documents_of_kinds(docs, "importation")
    assert {(r.doc_id, r.doc_kind, tuple(r.missing or ())) for r in kinds.collect()} == {("a", "invoice", ()), ("b", "packing_list", ()), ("c", "unknown", ("doc_kind unknown: unknown",))}
    pairs = {name: [tuple(r) for r in p.orderBy("family", "check_ord").collect()] for name, p in (("whole", FL.run_flow(docs, "importation")["pairs"]), ("some", FL.pairs_of_texts(docs, "importation")))}
    assert pairs["whole"] == pairs["some"] and len(pairs["some"]) == 5


def test_resumed_checks_writes_few_files(spark, tmp_path, monkeypatch):
    """F1: a file, a block of the disk at least, for each document and run: 7,500 at sf0.001, and long fields beside them."""
    from tradeloom.plans import result_queries as Q
    from tradeloom.sources import tables

    for module in (Q, tables):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}")
    assert Q.resumed_checks(spark, "/root/testdata/sf0.001").count() == 39000
    files = [f for f in tmp_path.rglob("*") if f.is_file() and not f.name.startswith(".")]
    assert 0 < len(files) < 100
