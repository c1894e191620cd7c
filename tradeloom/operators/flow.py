"""The joined flow: page texts -> kind -> fields with evidence -> checks -> report.

Documents come in as (run_id, doc_id, original_file, hint, text). Kinds are
filtered projections of one dealt table that are united in long form, so that
the texts are read and dealt once and no Python runs per row.
"""

from __future__ import annotations

import os
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_lines, truncate_evidence
from ..sources.tables import written
from . import checks, report
from . import extract as X

FLOWS = ("importation", "exportation")
#: Names of the engines. The variables are the engine's own.
ENGINES = {"regex": "regex", "legacy": "regex", "llm": "llm", "codex": "llm"}
ENGINE_VARIABLE, FALLBACK_VARIABLE = "TRADELOOM_ENGINE", "TRADELOOM_FALLBACK_TO_RULES"
#: Group checks: name, roles, aliases, mode.
GROUPS = {
    "importation": [
        ("shipper", ["invoice", "packing", "bl"], ["shipper_name"], "shipper"),
        ("consignee_cnpj", ["invoice", "packing", "bl"], {"invoice": ["importer_cnpj", "consignee_cnpj"], "packing": ["consignee_cnpj", "importer_cnpj"], "bl": ["consignee_cnpj", "importer_cnpj"]}, "cnpj"),
    ],
    "exportation": [
        ("exporter_name", ["invoice", "bl", "coo"], ["exporter_name"], "string"),
        ("importer_name", ["invoice", "bl", "coo"], ["importer_name"], "string"),
        ("exporter_cnpj", ["invoice", "bl"], ["exporter_cnpj"], "cnpj"),
    ],
}


def normalize_flow(flow: str) -> str:
    name = (flow or "").strip().lower()
    if name not in FLOWS:
        raise ValueError(f"flow must be one of {', '.join(FLOWS)}: {flow!r}")
    return name


def resolve_engine(engine: str | None = None) -> str:
    name = (engine or os.environ.get(ENGINE_VARIABLE, "regex")).strip().lower()
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; known are {', '.join(sorted(ENGINES))}")
    return ENGINES[name]


def falls_back() -> bool:
    """Whether a failing model gives way to the rules."""
    return os.environ.get(FALLBACK_VARIABLE, "").strip().lower() in ("1", "true", "yes", "on")


def document_kind(flow: str, model: bool = False) -> Column:
    """By the hint, else by the text (and, for export, the name); a model knows more marks of declarations and licences."""
    text = F.coalesce("text", F.lit(""))
    found = X.detect_kind_import(text, model) if flow == "importation" else X.infer_kind_export(F.col("original_file"), text)
    return F.coalesce(X.hint_kind(F.col("hint"), flow), found)


def _long(x: DataFrame, flow: str, kind: str, names: Collection[str] | None = None) -> DataFrame:
    """An extracted row in long form: a struct for each field, with required, present, evidence and method.

    Fields are put into one array, by their types, and one expression over it
    does the rest: what is built does not grow with the fields but by a line each.
    Of some fields alone it is not told which are required, and nothing is warned of.
    """
    spared = X.optional(flow, kind) if names is None else {}
    # By type: the text, number and list of a field, and what its evidence is looked for by.
    forms = {
        "string": ("`{0}`", "NULL", "NULL", "`{0}`"),
        "boolean": ("CAST(`{0}` AS STRING)", "NULL", "NULL", "NULL"),
        "number": ("NULL", "CAST(`{0}` AS DOUBLE)", "NULL", "NULL"),
        "array<string>": ("NULL", "NULL", "`{0}`", "get(`{0}`, 0)"),
        "array": ("NULL", "NULL", "transform(`{0}`, i -> to_json(i))", "NULL"),
    }
    types, rows = dict(x.dtypes), []
    for f, required, _ in X.rules_of(flow, kind, names):
        t = "number" if types[f] in ("double", "bigint", "int") else types[f] if types[f] in forms else "array"
        text, number, items, token = (e.format(f) for e in forms[t])
        need = f"NOT ({spared[f]})" if f in spared else str(required).lower()
        rows.append(f"struct('{f}' AS field, {need} AS required, CAST({text} AS STRING) AS value_str, CAST({number} AS DOUBLE) AS value_num, CAST({items} AS ARRAY<STRING>) AS value_list, CAST({token} AS STRING) AS token)")
    none = F.array().cast("array<string>")

    def full(v: Column) -> Column:
        # An export text that says nothing - a dash, N/A - is not there.
        says = X.clean_token(v["value_str"]).isNotNull() if flow == "exportation" else F.coalesce(F.btrim(v["value_str"]) != "", F.lit(False))
        present = says | v["value_num"].isNotNull() | F.coalesce(F.size(v["value_list"]) > 0, F.lit(False))
        evidence = F.when(present & v["token"].isNotNull(), truncate_evidence(evidence_lines(F.col("lines"), v["token"])))
        return F.struct(v["field"].alias("field"), v["required"].alias("required"), present.alias("present"), v["value_str"].alias("value_str"), v["value_num"].alias("value_num"), v["value_list"].alias("value_list"), F.coalesce(evidence, none).alias("evidence"), F.lit("regex").alias("method"))

    fields = F.transform(F.expr(f"array({', '.join(rows)})"), full)
    if names is not None:
        fields = F.transform(fields, lambda f: f.dropFields("required"))
    said = [] if names is not None else [F.concat("warnings", X.row_warnings(flow, kind)).alias("warnings")]
    return x.select("run_id", "doc_id", "original_file", "doc_kind", fields.alias("fields"), *said)


def extract_wide(docs: DataFrame, flow: str, names: Collection[str] | None = None, kinds: Collection[str] | None = None) -> DataFrame:
    """One row for each document: kind, fields (an array, absent ones too), missing, warnings.

    names, kinds: only these fields are found, only documents of these kinds are
    gone through, for what reads no others; missing and warnings, which are of
    all fields, are then not there.
    """
    flow = normalize_flow(flow)
    dealt = X.deal(docs.select("run_id", "doc_id", "original_file", document_kind(flow).alias("doc_kind"), "text"), "run_id")
    # A generator between: else the filter of each kind would go below the exchange, and all that makes the texts would run for each.
    dealt = dealt.select("run_id", F.explode(F.array(F.struct("doc_id", "original_file", "doc_kind", "text"))).alias("d")).select("run_id", "d.*")
    known = list(X.EXPORT if flow == "exportation" else X.IMPORT)
    asked = [k for k in known if (kinds is None or k in kinds) and X.rules_of(flow, k, names)]
    every = None
    # Kinds of the same rules are extracted together.
    table, same = X.EXPORT if flow == "exportation" else X.IMPORT, {}
    for kind in asked:
        same.setdefault(id(table[kind]), []).append(kind)
    for alike in same.values():
        x = X.extract_kind(dealt.where(F.col("doc_kind").isin(alike)), flow, alike[0], with_lines=True, names=names)
        one = _long(x, flow, alike[0], names)
        every = one if every is None else every.unionByName(one)
    if names is not None:
        other = dealt.where(~F.col("doc_kind").isin(asked) & (F.lit(kinds is None) | F.col("doc_kind").isin(list(kinds or ())))).drop("text")
        return every.unionByName(other.withColumn("fields", F.lit(None).cast(every.schema["fields"].dataType)))
    lacks = F.transform(F.filter("fields", lambda f: f["required"] & ~f["present"]), lambda f: f["field"])
    every = every.withColumn("missing", lacks)
    other = unknown_kinds(dealt.where(~F.col("doc_kind").isin(list(known))), flow)
    return every.unionByName(other.withColumn("fields", F.lit(None).cast(every.schema["fields"].dataType)).select(*every.columns))


def documents_of_kinds(docs: DataFrame, flow: str) -> DataFrame:
    """The documents with their kinds, and what is said of those of no known kind; none is extracted, so missing and warnings of the others are null."""
    flow = normalize_flow(flow)
    d = docs.select("run_id", "doc_id", "original_file", document_kind(flow).alias("doc_kind"))
    other = ~F.col("doc_kind").isin(list(X.EXPORT if flow == "exportation" else X.IMPORT))
    told = unknown_kinds(d, flow)
    return told.select(*d.columns, *[F.when(other, F.col(c)).alias(c) for c in ("warnings", "missing")])


def unknown_kinds(docs: DataFrame, flow: str) -> DataFrame:
    """Documents of no known kind: one fails an import document and only warns on an export one."""
    empty = F.array().cast("array<string>")
    said = F.array(F.concat(F.lit("unsupported_doc_kind:" if flow == "exportation" else "doc_kind unknown: "), "doc_kind"))
    warns, lacks = (said, empty) if flow == "exportation" else (empty, said)
    return docs.select("run_id", "doc_id", "original_file", "doc_kind", warns.alias("warnings"), lacks.alias("missing"))


def extract_documents(docs: DataFrame, flow: str) -> tuple[DataFrame, DataFrame]:
    """Documents (…, doc_kind, missing, warnings) and their fields in long form, absent ones too."""
    every = extract_wide(docs, flow)
    return every.drop("fields"), long_fields(every)


def long_fields(wide: DataFrame) -> DataFrame:
    """The fields of extract_wide, a row each."""
    return wide.select("run_id", "doc_id", "doc_kind", F.explode("fields").alias("f")).select("run_id", "doc_id", "doc_kind", "f.*")


def present_fields(fields: DataFrame) -> DataFrame:
    return fields.where("present").select("run_id", "doc_id", "field", "value_str", "value_num", "value_list", "evidence")


def with_map(wide: DataFrame) -> DataFrame:
    """Documents of extract_wide with the map of their present fields, as checks take it, dealt by run_id."""
    there = F.filter(F.coalesce("fields", F.array().cast(wide.schema["fields"].dataType)), lambda f: f["present"])
    entries = F.transform(there, lambda f: F.struct(f["field"].alias("k"), F.struct(f["value_str"].alias("value_str"), f["value_num"].alias("value_num"), f["value_list"].alias("value_list"), f["evidence"].alias("evidence")).alias("v")))
    return wide.select("run_id", "doc_id", "doc_kind", "original_file", F.map_from_entries(entries).alias("m")).repartition("run_id")


def compare(docs: DataFrame, fields: DataFrame | None, flow: str) -> dict[str, DataFrame]:
    """pairs, groups, rules and the summary of all runs; docs have the map of their fields where fields is None."""
    f = None if fields is None else present_fields(fields)
    d = docs if fields is None else docs.select("run_id", "doc_id", "doc_kind", "original_file")
    groups = None
    for name, roles, keys, mode in GROUPS[flow]:
        g = checks.group_check(d, f, flow, roles, keys, mode).withColumn("check", F.lit(name))
        groups = g if groups is None else groups.unionByName(g)
    pairs, rules = checks.pair_checks(d, f, flow), checks.freight_rule(d, f, flow)
    return {"pairs": pairs, "groups": groups, "rules": rules, "summary": checks.stage_summary(pairs, groups, rules)}


def pairs_of_texts(docs: DataFrame, flow: str) -> DataFrame:
    """The pair checks of run_flow alone: of the documents only the fields that these checks read are found."""
    flow = normalize_flow(flow)
    return checks.pair_checks(with_map(written(extract_wide(docs, flow, checks.fields_read(flow)))), None, flow)


def document_report(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document: required and all fields, how many are present, what is missing, FAIL, ALERT or OK, and its place in the report."""
    n = lambda c, name: F.count_if(c).alias(name)
    counts = fields.groupBy("run_id", "doc_id").agg(F.count("*").alias("fields_total"), n(F.col("present"), "fields_present"), n(F.col("required"), "required_total"), n(F.col("required") & F.col("present"), "required_present"))
    out = docs.join(counts, ["run_id", "doc_id"], "left").na.fill(0)
    status = F.when(F.size("missing") > 0, "FAIL").when(F.size("warnings") > 0, "ALERT").otherwise("OK")
    return report.in_report_order(out.withColumn("n_missing", F.size("missing").cast("long")).withColumn("status", status))


def run_flow(docs: DataFrame, flow: str) -> dict[str, DataFrame]:
    """All of a flow: documents, fields, pairs, groups, rules, summary, status of documents and of runs."""
    flow = normalize_flow(flow)
    # Written once: all that follows reads it, some of it several times.
    wide = written(extract_wide(docs, flow))
    d, fields = wide.drop("fields"), long_fields(wide)
    out = {"documents": d, "fields": fields, **compare(with_map(wide), None, flow), "status": document_report(d, fields)}
    out["overall"] = report.overall_status(out["status"], out["pairs"])
    return out
