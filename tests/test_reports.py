"""Reports of whole tables: what they shuffle and write, and that documents with maps give what fields in long form give."""

import json
import re

import pytest
from oracle import DATA

from tradeloom.operators import checks as K
from tradeloom.operators import run_report as RR


@pytest.mark.parametrize("name", ["report_runs", "report_markdown", "debug_report_totals"])
def test_reports_deal_once_and_write_nothing(spark, name):
    """Neither fields in long form nor check rows are written or shuffled: only line items by order and shipments by run."""
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, f"{DATA}/sf0.001")
    dealt = set(re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString()))
    assert dealt <= {"k", "l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "sk", "s_suppkey", "doc_kind"}, dealt
    assert all("/testdata/" in f for f in df.inputFiles())


def test_maps_and_long_fields_agree(spark):
    """Stored and found lacks, a document without fields, a run without checks and one without documents, more matches than a list shows."""
    kind = "run_id long, doc_id string, original_file string, doc_kind string, missing array<string>, warnings array<string>"
    docs = spark.createDataFrame([(1, "a", "A.pdf", "invoice", [], ["w"]), (1, "b", None, "bl", ["ncm"], None), (1, "c", "C.pdf", "di", None, []), (2, "d", "D.pdf", "invoice", [], [])], kind)
    value = "value_str string, value_num double, value_list array<string>, present boolean, required boolean, method string, evidence array<string>"
    rows = [(1, "a", "number", "I-1", None, None, True, True, "m", ["l"]), (1, "a", "weight", None, 1.5, None, True, False, None, None), (1, "b", "ncm", None, None, None, False, True, "", []), (2, "d", "items", None, None, ["x"], True, None, "m", [])]
    fields = spark.createDataFrame(rows, f"run_id long, doc_id string, field string, {value}")
    fields.createOrReplaceTempView("long_fields")
    maps = spark.sql("SELECT run_id, doc_id, map_from_entries(collect_list(struct(field, struct(value_str, value_num, value_list, present, required, method, evidence)))) AS m FROM long_fields GROUP BY ALL")
    mapped = docs.join(maps, ["run_id", "doc_id"], "left").selectExpr(*docs.columns, f"coalesce(m, map_from_entries(CAST(array() AS array<struct<key:string,value:struct<{value.replace(' ', ':').replace(',:', ',')}>>>))) AS m")
    checks = [(r, "pair", i, "f | A <> B", f"c{i}", s, None, "x", "y", "", "", b) for r, s, b, n in ((1, "match", "matches", 201), (1, "divergent", "divergent", 2), (3, "skipped", "skipped", 1)) for i in range(n)]
    checks = spark.createDataFrame(checks, "run_id long, bucket string, ord long, pair string, field string, status string, reason string, a_value string, b_value string, evidence_a string, evidence_b string, list string")
    for make in (RR.run_reports, RR.debug_reports):
        one, two = ({r["run_id"]: json.loads(r["j"]) for r in make(d, f, checks).selectExpr("run_id", "to_json(struct(*)) AS j").collect()} for d, f in ((docs, fields), (mapped, None)))
        assert one == two and set(one) == {1, 2, 3}
    got = {r["run_id"]: r for r in RR.run_reports(mapped, None, checks).collect()}
    assert (got[1]["overall"]["status"], got[1]["overall"]["reasons"]) == ("FAIL", ["missing_required_fields=1", "divergences=2", "warnings=1"])
    assert (len(got[1]["lists"]["matches"]), got[1]["counts"]["matches"], got[2]["summary"], got[3]["documents"]) == (RR.JSON_MATCHES, 201, None, None)
    assert [(d["stage01_file"], d["status"], d["missing_required_fields"], d["fields_total"]) for d in got[1]["documents"]] == [("b", "FAIL", ["ncm"], 1), ("a", "ALERT", [], 2), ("c", "OK", [], 0)]


def test_values_are_made_once(spark):
    """A value is looked for once for a row and side: a plan that is executed holds each search of a map's keys once."""
    import __spark_entry__

    plan = __spark_entry__.queries()["summary_import"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"transform\(a_keys", plan)) == 1 and len(re.findall(r"transform\(b_keys", plan)) == 1
    assert K.SPECS["importation"] is K.IMPORT_SPECS


def test_results_are_read_from_variant_once(spark):
    """Odd results of every layout, and plans that take each field from VARIANT once and not for every use of it."""
    from tradeloom.operators.normalise import normalise

    rows = [
        (1, '{"comparisons": [{"field": "", "check": 7, "status": "match", "evidence": {"a": ["x", "y", "z"]}}, 3, null], "groups": {}, "rule_checks": [{"rule": "r", "field": "", "rule_check": "f", "status": "PASS", "invoice_incoterm": "FOB"}], "summary": {"matches": null, "total_checks": "4"}}'),
        (2, '{"pairs": [], "pair_checks": [{"campo": {"b": 1, "a": 2}, "status": "ok", "evidence": 1, "evidence_a": "e"}], "groups": [{"group": "g", "items": [{"doc": "", "doc_kind": "bl"}, 5]}], "summary": {"pairs": 3}}'),
        (3, "[1]"), (4, None), (5, "{}"), (6, '{"summary": {"pairs": {"total": 2.0, "matches": "1"}}}'),
    ]
    got, counts = normalise(spark.createDataFrame(rows, "run_id long, result string"))
    columns = ("run_id", "ord", "bucket", "field", "status", "a_value", "evidence_a", "list")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == [
        (1, 0, "pair", "7", "match", None, "x\ny", "matches"), (1, 1, "pair", None, None, None, "", None), (1, 2, "pair", None, None, None, "", None), (1, 3, "rule", "f", "PASS", "FOB", "", "matches"),
        (2, 0, "pair", '{"a":2,"b":1}', "ok", None, "e", None), (2, 1, "group", "g", None, "bl: None; doc: None", "", None),
    ]
    assert sorted(map(tuple, counts.collect())) == [
        (1, "legacy", 4, 0, 0, 0), (2, "new, counted", 2, 0, 0, 0), (3, "broken", 0, 0, 0, 0), (4, "broken", 0, 0, 0, 0), (5, "new, counted", 0, 0, 0, 0), (6, "new", 2, 1, 0, 0),
    ]
    for df, most in ((got, 2), (counts, 6)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("variant_get(") <= most and "schema_of_variant" not in plan and plan.count("parseJson") == 1
