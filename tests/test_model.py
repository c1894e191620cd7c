"""A model behind a client: one call a document, whole answers checked, bad ones told, rules as a fallback."""

import json
import re
from pathlib import Path

import pytest

from tradeloom.operators import extract as X
from tradeloom.operators import model as M

# The contract's two documents.
DOCS = {
    "importation": ("INVOICE.pdf", "invoice", "INVOICE NO DN-24139\nCNPJ 03.562.381/0006-03"),
    "exportation": ("COMMERCIAL INVOICE.pdf", "commercial_invoice", "COMMERCIAL INVOICE\nINVOICE NR I-0007/25\nCNPJ 03.562.381/0006-03"),
}


def answering(log):
    """A client that fills the prompt's template and notes every call."""

    def client(prompt):
        with open(log, "a") as f:
            f.write("call\n")
        if "BAD" in prompt:
            return "no JSON"
        if "DOWN" in prompt:
            raise TimeoutError("240 s")
        filled = json.loads(prompt.partition("TEMPLATE\n")[2].partition("\n\nTEXT\n")[0])
        for name, meta in filled["fields"].items():
            if meta["required"]:
                meta |= {"present": True, "value": f"mock_{name}", "evidence": [f"evidence_{name}"], "method": "llm_manual"}
            else:
                meta["method"] = "llm_manual"
        if "net_weight_kg" in filled["fields"]:
            filled["fields"]["net_weight_kg"]["value"] = 53.772
        return "```json\n" + json.dumps(filled) + "\n```"

    return client


@pytest.mark.parametrize("flow", DOCS)
def test_contract(spark, flow, tmp_path):
    name, kind, text = DOCS[flow]
    log = tmp_path / "calls"
    rows = [(1, "d1", name, kind, text), (1, "d2", name, kind, text + "\nBAD"), (2, "d1", name, kind, text + "\nDOWN"), (2, "d3", "x.pdf", None, "nothing that is known")]
    docs = spark.createDataFrame(rows, "run_id long, doc_id string, original_file string, hint string, text string")
    out, fields = M.extract_with_model(docs, flow, answering(log))
    got = {(r["run_id"], r["doc_id"]): r for r in out.collect()}
    f = {r["field"]: r for r in fields.where("run_id = 1 and doc_id = 'd1'").collect()}
    out.count(), fields.count()
    assert len(log.read_text().splitlines()) == 3
    assert set(f) == {n for n, _ in M.specs(flow, kind)}
    assert got[1, "d1"]["missing"] == [] and got[1, "d1"]["warnings"] == []
    assert all(r["value_str"] == f"mock_{n}" and r["evidence"] == [f"evidence_{n}"] for n, r in f.items() if r["required"] and n != "net_weight_kg")
    assert (f["net_weight_kg"]["value_num"], f["net_weight_kg"]["value_str"]) == (53.772, None)
    assert got[1, "d2"]["warnings"] == ["the answer is no JSON object"] and got[2, "d1"]["warnings"] == ["the model's client failed: 240 s"]
    told = "unsupported_doc_kind:unknown" if flow == "exportation" else "doc_kind unknown: unknown"
    assert told in got[2, "d3"]["warnings"] + got[2, "d3"]["missing"]


def test_fallback_reads_only_the_bad(spark, tmp_path):
    name, kind, text = DOCS["importation"]
    docs = spark.createDataFrame([(1, "d", name, kind, text), (2, "d", name, kind, text + "\nBAD")], "run_id long, doc_id string, original_file string, hint string, text string")
    out, fields = M.extract_with_model(docs, "importation", answering(tmp_path / "calls"), fallback=True)
    got = {(r["run_id"], r["value_str"], r["method"]) for r in fields.where("field = 'invoice_number'").collect()}
    assert got == {(1, "mock_invoice_number", "llm_manual"), (2, "DN-24139", "regex")}
    assert out.count() == 2 and len((tmp_path / "calls").read_text().splitlines()) == 2


def test_every_kind_is_guided():
    for flow, table in (("importation", X.IMPORT), ("exportation", X.EXPORT)):
        for kind in table:
            asked = M.prompt(flow, kind, "t", M.template(flow, kind, "s", "o", "h", "now"))
            assert "Look for:" in asked and all(f'"{n}"' in asked for n, _ in M.specs(flow, kind))


def lines(spark, text, flow, kind):
    x = X.extract_kind(spark.createDataFrame([(text,)], "text string"), flow, kind, with_lines=True)
    return x.select("*", X.missing_required(x, flow, kind).alias("missing"), X.row_warnings(flow, kind).alias("rows")).collect()[0].asDict(recursive=True)


def test_packing_items(spark):
    text = "PACKING LIST DN-12345\n* MODEL: A-1\n1 - 3 3 CARTONS @199 @264 1,2 3,6\n597 792\n5 1 CARTON @9 @9 1 2,5\n6 2 CARTONS @9 @9 1 2,5\n* MODEL: B2\n7 4 CARTONS @9 @9 1 2,5\n* MODEL: C\n8 5 CARTONS @9 @9 1 2,5\n9"
    r = lines(spark, text, "importation", "packing_list")
    got = [(i["model"], i["no"], i["packages"], i["net_weight_kg"], i["gross_weight_kg"]) for i in r["items"]]
    # A row takes the line below for its weights, whatever it is: a row, a model.
    assert got == [("A-1", "1 - 3", 3, 597.0, 792.0), ("A-1", "5", 1, 6.0, 2.0), ("B2", "7", 4, None, None), ("B2", "8", 5, None, None)]
    assert r["packages_total"] == 13 and r["warnings"] == []


def test_packing_compact(spark):
    total = "TOTAL : 9 CARTONS 50,00 90,00 7.5"
    r = lines(spark, f"PACKING LIST DN-12345\nABCDEF99 INVOICE something\nAB12CD34 OUTBOARD MOTOR\n{total}", "importation", "packing_list")
    assert [(i["model"], i["packages"], i["net_weight_kg"], i["raw_line"]) for i in r["items"]] == [("AB12CD34", 9, 50.0, "AB12CD34 OUTBOARD MOTOR")]
    assert r["warnings"] == ["packing_items_compact_fallback_used"] and "items" not in r["missing"]
    r = lines(spark, f"PACKING LIST DN-12345\n{total}", "importation", "packing_list")
    assert [(i["model"], i["m3_total"], i["raw_line"]) for i in r["items"]] == [("SUMMARY", 7.5, "summary_from_totals")]
    r = lines(spark, "PACKING LIST DN-12345\nTOTAL VOLUME in M3", "importation", "packing_list")
    assert r["items"] == [] and "items" in r["missing"] and r["warnings"] == ["packing_total_volume_found_without_numeric_value"]


def test_many_packing_rows(spark):
    """50,000 rows under 5,000 models, in time that grows with the rows."""
    import time

    rows = [f"* MODEL: M{i}\n" + "\n".join(f"{k} 2 CARTONS @1 @2 1 3,5\n10 {k}" for k in range(10)) for i in range(5000)]
    docs = spark.createDataFrame([("\n".join(rows),)], "text string")
    began = time.time()
    x = X.extract_kind(docs, "importation", "packing_list").selectExpr("size(items) AS n", "items[49999].model AS m", "packages_total AS p").collect()[0]
    assert (x["n"], x["m"], x["p"]) == (50000, "M4999", 100000) and time.time() - began < 60


def test_empty_due_is_optional(spark):
    head = "BILL OF LADING\nFREIGHT COLLECT\n"
    r = lines(spark, head + "DUE: .\n", "exportation", "draft_bl")
    assert r["due"] is None and "due" not in r["missing"] and r["warnings"] == ['DUE appears empty (example: "DUE: .") and was treated as missing.']
    r = lines(spark, head, "exportation", "draft_bl")
    assert "due" in r["missing"] and r["warnings"] == []


def test_tariff_digits(spark):
    r = lines(spark, "BILL OF LADING\nNCM 87032", "importation", "bl")
    assert r["ncm"] == "87032" and r["rows"] == ["NCM/HS com 5 digitos (87032). Verificar."]
    assert lines(spark, "BILL OF LADING\nNCM 870321", "importation", "bl")["rows"] == []


def test_sections(spark):
    long_ = "\n".join(f"linha {i}" for i in range(45))
    li = "CONFERENCIA LI\nINFORMAÇÕES - IMPORTADOR\nINFORMA sem traço\nENDEREÇO: RUA 1\n" + long_ + "\nCIDADE: ITAJAI\nINFORMAÇÕES - CARGA\nPAIS: FORA"
    r = lines(spark, li, "importation", "li")
    assert (r["importer_address"], r["importer_city"], r["importer_country"]) == ("RUA 1", "ITAJAI", None)
    di = "CONFERENCIA DI\nINFORMACOES - IMPORTADOR\nNÚMERO\n:\nsem\n 12\nINFORMA\nBAIRRO: FORA\nTRANSPORTADOR: É: MAR"
    r = lines(spark, di, "importation", "di")
    assert (r["importer_number"], r["importer_neighborhood"], r["transport_carrier"]) == ("12", None, "É: MAR")
    assert lines(spark, "CONFERENCIA DI\nBAIRRO: CENTRO", "importation", "di")["importer_neighborhood"] == "CENTRO"


def test_importer_and_shipper(spark):
    r = lines(spark, "COMMERCIAL INVOICE 1\nx y\nACME IMPORTADORA LTDA\nCOD. FISCALE\nlower case", "importation", "invoice")
    assert r["importer_name"] == "ACME IMPORTADORA LTDA"
    assert lines(spark, "INVOICE\nFROM SUZUKI  MOTOR CORP JAPAN\nOTHER SA", "importation", "invoice")["shipper_name"] == "SUZUKI MOTOR CORP JAPAN"


def test_rules_as_data_do_not_grow_the_plan(spark):
    """The plan of a kind with labels has one expression for all of them."""
    docs = spark.createDataFrame([("x",)], "text string")
    plan = X.extract_kind(docs, "importation", "di")._jdf.queryExecution().analyzed().toString()
    assert len(re.findall("shared_labels#", plan.splitlines()[0])) <= 2 * len(X.DI_LABELS)
    assert all(x.field in dict((f, 1) for f, _, _ in X.IMPORT["di"]) for x in X.DI_LABELS) and Path(X.__file__).exists()
