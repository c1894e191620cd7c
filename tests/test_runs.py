"""Stages from their files, whole flows, reports and the data source of named files."""

import json
import re
import sys
from pathlib import Path

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tradeloom import runs
from tradeloom.operators import checks as K
from tradeloom.operators import flow as FL
from tradeloom.operators import run_report as RR
from tradeloom.sources import stages as S
from tradeloom.sources.files import read_files, write_files
from tradeloom.sources.tables import written

HERE = Path(__file__).parent


@pytest.fixture(scope="module")
def texts():
    return {m[1]: m[2] for m in re.finditer(r"\*\*(\w+ [A-Z ]+\.pdf)\*\*[^\n]*\n\n```text\n(.*?)\n```", (HERE.parent / "FIXTURES.md").read_text(), re.S)}


@pytest.fixture(scope="module")
def inputs(tmp_path_factory, texts):
    """A folder with three runs: import documents at the top and under 7, one of them broken; a side-car file at the top."""
    root = tmp_path_factory.mktemp("in")
    for run in ("", "7"):
        folder = root / "importation" / "raw" / run
        folder.mkdir(parents=True, exist_ok=True)
        for name, text in texts.items():
            if name.startswith("import "):
                (folder / name.removeprefix("import ")).write_text(text)
    (root / "importation" / "raw" / "7" / "SCAN.pdf").write_text("broken")
    (root / "importation" / "raw" / "_original_file_names.json").write_text('﻿{"BL.pdf": "Original BL.pdf", "x": 1}')
    return root


@pytest.fixture(scope="module")
def done(spark, inputs, tmp_path_factory):
    sys.path.insert(0, str(HERE))
    out = tmp_path_factory.mktemp("out")
    return out, runs.run_flow(spark, str(inputs), str(out), "importation", read="pdf_text:read", min_chars=10)


def files(folder, pattern):
    return {p.name: p.read_text() for p in Path(folder).rglob(pattern)}


def test_flow(spark, done):
    out, result = done
    assert result.success and result.errors == [] and result.stages_completed == list(runs.STAGES.values())
    assert result.metadata["documents_processed"] == 7
    stage01 = S.read_stage01(spark, result.output_files["stage_01"]).collect()
    assert {(r["run_id"], r["file"]) for r in stage01} >= {(0, "Original BL.pdf"), (7, "BL.pdf"), (7, "SCAN.pdf")}
    scan = next(r for r in stage01 if r["file"] == "SCAN.pdf")
    assert scan["warnings"] == ["page 1: no PDF"] and scan["pages"][0]["method"] == "ocr_error"
    text = next(t for n, t in files(out, "BL_extracted.txt").items() if "SOURCE FILE" in t)
    assert text.startswith("FILE: Original BL.pdf\nSOURCE FILE: BL.pdf\nTESSERACT: (none)\n") and "--- PAGE 001 | method=direct | chars=" in text
    summary = json.loads(files(f"{out}/stage_02_fields", "_stage02_summary.json")["_stage02_summary.json"])
    assert summary["processed_count"] in (3, 4) and summary["overwritten_count"] == 0


def test_reports(done):
    out, _ = done
    reports = [json.loads(t) for p in Path(out, "stage_04_report").rglob("_stage04_report.json") for t in [p.read_text()]]
    assert len(reports) == 2
    for r in reports:
        assert r["overall"]["status"] == "FAIL" and r["overall"]["reasons"][0].startswith("missing_required_fields=")
        assert r["stage03"]["summary"]["total"] == sum(len(r["lists"][n]) for n in ("divergent", "skipped", "matches"))
        ranks = [("FAIL", "ALERT", "OK").index(d["status"]) for d in r["stage02"]["documents"]]
        assert ranks == sorted(ranks)
    scan = next(r for r in reports if any(d["original_file"] == "SCAN.pdf" for d in r["stage02"]["documents"]))
    assert {d["file"]: (d["pages"], d["direct_pages"]) for d in scan["stage01_quality"]["documents"]}["SCAN.pdf"] == (1, 0)
    md = next(t for t in (p.read_text() for p in Path(out, "stage_04_report").rglob("*.md")) if "Original BL.pdf" in t)
    assert "| BL | 1 | OK |" in md and "| HBL | 0 | MISSING |" in md and "| Original BL.pdf | 1 | 1 | 0 |" in md
    html = next(iter(files(f"{out}/stage_04_report", "*.html").values()))
    assert html.startswith("<!DOCTYPE html>") and '<p class="fail">Overall: FAIL</p>' in html
    debug = json.loads(next(iter(files(f"{out}/stage_05_debug_report", "*.json").values())))
    invoice = next(d for d in debug["stage02"]["documents"] if d["doc_kind"] == "invoice")
    assert next(f for f in invoice["fields"] if f["field"] == "invoice_number")["value"] == "INV-TEST-001"
    assert [f["field"] for f in invoice["fields"]] == sorted(f["field"] for f in invoice["fields"])
    assert any("| invoice_number | true | true | regex | INV-TEST-001 |" in t for t in (p.read_text() for p in Path(out, "stage_05_debug_report").rglob("*.md")))


def test_joined_flow_gives_the_same(spark, done):
    """The stages from files agree with the flow that never writes any."""
    out, result = done
    docs = S.documents_for_fields(S.read_stage01(spark, result.output_files["stage_01"]))
    joined = FL.run_flow(docs, "importation")
    rows = RR.flow_rows(joined["pairs"], joined["groups"], joined["rules"], "importation")
    normal, summary = runs.normalise(S.read_stage03(spark, result.output_files["stage_03"]))
    plain = lambda df: sorted(map(repr, df.select("run_id", "bucket", "field", "status", "reason", "a_value", "b_value", "evidence_a", "evidence_b", "list").collect()))
    assert plain(rows) == plain(normal)
    assert [r["layout"] for r in summary.collect()] == ["hybrid", "hybrid"]
    status = {(r["run_id"], r["doc_id"]): r["status"] for r in joined["status"].collect()}
    written, fields = S.read_stage02(spark, result.output_files["stage_02"])
    assert {(r["run_id"], r["doc_id"]): r["status"] for r in RR.document_rows(written, fields).collect()} == status


def test_numbers_stay_numbers(spark, tmp_path):
    """53.772 written as a number is not read as 53772 again, nor 12345678.9 by its exponent."""
    docs = spark.createDataFrame([(1, "a__b_extracted.json", "A.pdf", "invoice", [], [])], "run_id long, doc_id string, original_file string, doc_kind string, missing array<string>, warnings array<string>")
    rows = [("net_weight_kg", None, 53.772, None), ("gross_weight_kg", None, 12345678.9, None), ("text", 'say "53.772"\n\\', None, None), ("containers", None, None, ['{"container_number":"TEMU1680211","n":1.5}', "plain"]), ("flag", "true", None, None), ("none", None, None, None), ("empty", None, None, [])]
    fields = spark.createDataFrame([(1, "a__b_extracted.json", f, f != "none", True, s, n, v, ["e"], "regex") for f, s, n, v in rows], "run_id long, doc_id string, field string, present boolean, required boolean, value_str string, value_num double, value_list array<string>, evidence array<string>, method string")
    S.write_stage02(docs, fields, str(tmp_path / "two"), "importation", "now")
    assert set(files(tmp_path, "*.json")) == {"a_b_fields.json", "_stage02_summary.json"}
    d, f = S.read_stage02(spark, str(tmp_path / "two"))
    assert d.collect()[0]["doc_id"] == "a__b_extracted.json"
    got = {r["field"]: (r["value_str"], r["value_num"], r["value_list"]) for r in f.collect()}
    assert got == {f: (s, n, v) for f, s, n, v in rows}


def test_files_of_other_writers(spark):
    """Fields at the top of a document, evidence as snippets, files that are no JSON."""
    one = {"source": {"stage01_file": "a", "doc_kind": "invoice"}, "invoice_number": {"value": "I-1", "locations": [{"snippet": "INVOICE I-1"}, {"page": 1}]}, "ncm": {"value": "1"}, "other": 5, "fields": {"ncm": {"value": "8703", "present": True, "evidence": ["NCM 8703"], "locations": [{"snippet": "no"}]}}}
    files = spark.createDataFrame([("1/a_fields.json", json.dumps(one)), ("1/b_fields.json", "broken"), ("1/c_fields.json", "[1]")], "name string, content string")
    docs, fields = S.parse_stage02(files)
    assert docs.count() == 1
    got = {r["field"]: (r["value_str"], r["evidence"]) for r in fields.collect()}
    assert got == {"invoice_number": ("I-1", ["INVOICE I-1"]), "ncm": ("8703", ["NCM 8703"])}


def test_export_reports(spark):
    """An export report has its own kinds and labels; a text that says nothing is not there."""
    docs = spark.createDataFrame([(1, "d", "D.pdf", "draft_bl", "BILL OF LADING\nWOODEN PACKAGE: -\nDUE: .\nRUC BR1")], "run_id long, doc_id string, original_file string, hint string, text string")
    wide = written(FL.extract_wide(docs, "exportation"))
    fields = FL.long_fields(wide)
    out = FL.compare(wide.drop("fields"), fields, "exportation")
    rows = written(RR.flow_rows(out["pairs"], out["groups"], out["rules"], "exportation"))
    r = written(RR.run_reports(wide.drop("fields"), fields, rows, flow="exportation"))
    md = r.select(RR.as_markdown("exportation", "now")).collect()[0][0]
    assert "| DRAFT BL | 1 | OK |" in md and "| COMMERCIAL INVOICE | 0 | MISSING |" in md and "DRAFT BL (D.pdf)" in md
    there = {f["field"]: (f["required"], f["present"]) for f in fields.collect()}
    assert there["due"] == (False, False) and there["ruc"] == (True, True)


def test_names_that_meet(spark, tmp_path):
    """Two documents of one name: the last is kept and the summary tells of the other."""
    kind = "run_id long, doc_id string, original_file string, doc_kind string, missing array<string>, warnings array<string>"
    docs = spark.createDataFrame([(1, "a__b_extracted.json", "A.pdf", "invoice", [], []), (1, "a_b_extracted.json", "B.pdf", "invoice", [], ["w"]), (2, "a_b_extracted.json", "C.pdf", "bl", ["ncm"], [])], kind)
    fields = spark.createDataFrame([], "run_id long, doc_id string, field string, present boolean, required boolean, value_str string, value_num double, value_list array<string>, evidence array<string>, method string")
    S.write_stage02(docs, fields, str(tmp_path), "importation", "now")
    d, f = S.read_stage02(spark, str(tmp_path))
    assert {(r["run_id"], r["original_file"]) for r in d.collect()} == {(1, "B.pdf"), (2, "C.pdf")} and f.collect() == []
    said = {n: json.loads(c) for n, c in read_files(spark, str(tmp_path), "*_stage02_summary.json").collect()}
    assert said["1/_stage02_summary.json"]["overwritten_count"] == 1 and said["2/_stage02_summary.json"]["documents"][0]["missing_required"] == 1


def test_named_files(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.range(50).select(F.concat(F.col("id").cast("string"), F.lit("/x.txt")).alias("name"), F.concat(F.lit("ü "), F.col("id").cast("string")).alias("content"))
    write_files(df.repartition(3), path)
    assert sorted(read_files(spark, path).collect()) == sorted(df.collect())
    write_files(spark.createDataFrame([("new.txt", None)], "name string, content string"), path, "append")
    assert read_files(spark, path).count() == 51 and [tuple(r) for r in read_files(spark, path, "new*").collect()] == [("new.txt", "")]
    with pytest.raises(Exception):
        write_files(df.union(spark.createDataFrame([("../out", "x")], "name string, content string")), path)
    assert read_files(spark, path).count() == 51 and not list(Path(path, "_staging").iterdir())
    write_files(df.limit(1), path)
    assert read_files(spark, path).count() == 1
    assert read_files(spark, str(tmp_path / "none")).collect() == []


def test_stages_and_command_line(spark, inputs, done, tmp_path, capsys):
    _, result = done
    with pytest.raises(ValueError, match="Missing required parameter: out_dir"):
        runs.run_stage(spark, 3, {"in_dir": "x"})
    for bad in (6, "x"):
        with pytest.raises(ValueError, match="Invalid stage number"):
            runs.run_stage(spark, bad, {})
    with pytest.raises(ValueError, match="flow must be one of"):
        runs.run_stage(spark, 3, {"flow": "other"})
    assert runs.main(["--stage", "3", "--param", f"in_dir={result.output_files['stage_02']}", "--param", f"out_dir={tmp_path}/three"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"processed_count": 7, "warnings": []}
    again, first = (sorted(r["result"].partition('"flow"')[2] for r in S.read_stage03(spark, p).collect()) for p in (f"{tmp_path}/three", result.output_files["stage_03"]))
    assert again == first
    assert runs.main(["--input", str(tmp_path / "nothing"), "--output", str(tmp_path / "o"), "--json"]) == 1
    told = json.loads("{" + capsys.readouterr().out.partition("{")[2])
    assert not told["success"] and told["stages_completed"] == [] and "no PDF for flow" in told["errors"][0]


def test_model_engine(spark, done, tmp_path, monkeypatch):
    """The second stage by a model: its own engine names, no client is an error, a bad answer falls back on the rules where that is wanted."""
    _, result = done
    params = {"in_dir": result.output_files["stage_01"], "out_dir": str(tmp_path / "two"), "engine": "codex"}
    with pytest.raises(ValueError, match="needs `client`"):
        runs.run_stage(spark, 2, params)
    with pytest.raises(ValueError, match="unknown engine"):
        runs.run_stage(spark, 2, params | {"engine": "other"})
    monkeypatch.setenv("TRADELOOM_FALLBACK_TO_RULES", "yes")
    assert runs.run_stage(spark, 2, params | {"client": lambda prompt: "nothing"}) == {"processed_count": 7, "warnings": []}
    docs, fields = S.read_stage02(spark, str(tmp_path / "two"))
    first, _ = S.read_stage02(spark, result.output_files["stage_02"])
    plain = lambda df: sorted(map(repr, df.select("run_id", "doc_id", "doc_kind", "missing").collect()))
    assert plain(docs) == plain(first) and fields.where("field = 'invoice_number' and present").count() > 0


def test_nested_containers(spark):
    """Numbers of containers at any depth: under their key, in values of objects and lists, in texts."""
    deep = {"a": [{"b": {"container_number": " temu1680211 ", "other": "MSKU0000001"}}, ["x MSCU1234567, y", 5, None]], "c": "no", "d": {"e": {"f": ["hlcu7654321"]}}}
    got = spark.createDataFrame([(1, [json.dumps(deep), "AAAU1111111 and AAAU1111111"]), (2, []), (3, None), (4, ["{broken TEMU0000001"])], "k long, v array<string>").select("k", K.container_numbers(F.col("v")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {1: ["AAAU1111111", "HLCU7654321", "MSCU1234567", "TEMU1680211"], 2: [], 3: [], 4: ["TEMU0000001"]}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_caps_are_of_each_run(spark, sf):
    from tradeloom.plans import result_queries as Q

    rows = Q.check_rows(spark, f"{DATA}/{sf}").withColumnRenamed("k", "run_id")
    got = RR.listed(rows, {"divergent": 1}).where("list = 'divergent'").groupBy("run_id").count()
    assert got.where("count > 1").isEmpty() and got.count() == rows.where("list = 'divergent'").select("run_id").distinct().count()


def test_checks_deal_documents_once(spark):
    """Line items by their order and shipments by run are all that checks of whole tables shuffle: neither maps of fields nor pairs."""
    import __spark_entry__

    for name in ("checks_import", "checks_export", "checks_licence", "top_divergent", "document_status", "overall_status"):
        plan = __spark_entry__.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan))
        assert dealt <= {"k", "l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "sk", "s_suppkey", "doc_kind"}, (name, dealt)
