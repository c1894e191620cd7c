"""Field extraction by a language model behind an injected client: template, prompt, salvage, strict validation.

The client is a function of a prompt; none is shipped. Answers are salvaged and
validated by column expressions over VARIANT, so a bad answer is a row with an
error and never a failed task.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import INCOTERMS
from ..functions.text import let
from ..sources.tables import written
from . import extract as X

#: Keys of an answer.
META = ["present", "required", "value", "evidence", "method"]
SOURCE = ["stage01_file", "original_file", "doc_kind", "doc_kind_hint"]
TOP = ["source", "generated_at", "fields", "missing_required_fields", "warnings"]


#: What a model is told to look for, by kind; a house bill is read as a bill is.
GUIDE = {
    "importation": {
        "invoice": ["the invoice's number and day, the terms of payment, the currency and the delivery term", "the importer (or consignee) with its legal name and CNPJ, and the shipper", "the countries of origin, acquisition and provenance", "net and gross weight in kg, the total quantity, and every line item"],
        "packing_list": ["the reference of the invoice or list", "the importer (or consignee) with its legal name and CNPJ, and the shipper", "the totals: packages, net and gross weight in kg, volume in m3", "every row of the table with model, packages, weights and volume"],
        "bl": ["the shipper, and the consignee (or importer) with its legal name and CNPJ", "the NCM or HS code and the gross weight in kg", "whether freight is collect or prepaid", "volume, notify party, port of loading and port of discharge"],
        "di": ["the importer with its legal name, CNPJ and address", "all invoice numbers in order, and the first one alone", "weights, NCM or HS code, the numbers of the declaration and of the bill", "way of transport, days of loading and arrival, type and place of the declaration"],
        "li": ["the importer with its legal name, CNPJ and address, and the exporter with its address", "the numbers of the licence, of its reference and of the invoice", "weights, NCM or HS code, countries of origin, provenance and acquisition", "quantity, unit, currency, condition of sale and delivery term"],
    },
    "exportation": {
        "commercial_invoice": ["number and day of the invoice, ports and way of transport", "exporter with CNPJ and importer", "weights in kg, NCM code, number of containers, currency and delivery term"],
        "packing_list": ["number and day of the list", "weights in kg, NCM code, number of containers and delivery term", "every container with its seal and values"],
        "draft_bl": ["freight mode, delivery term, NCM code, DUE, RUC and booking", "exporter with CNPJ, importer and notify party", "cartons, weights in kg, volume in m3 and every container"],
        "certificate_of_origin": ["number of the invoice, day of the certificate", "exporter and importer", "weights in kg or the area in m2: one of them at least"],
        "container_data": ["number of the invoice, booking", "every container with its seal and values"],
    },
}


def specs(flow: str, kind: str) -> list[tuple[str, bool]]:
    """(field, required) of a kind, as its rules have them; a certificate of origin asks the model for less."""
    optional = {"transport_mode", "net_weight_kg", "total_m2"} if kind == "certificate_of_origin" else set()
    return [(f, required and f not in optional) for f, required, _ in (X.EXPORT if flow == "exportation" else X.IMPORT).get(kind, [])]


def template(flow: str, kind: str, stage01_file: str = "", original_file: str = "", hint: str = "", now: str | None = None) -> dict:
    fields = {f: {"present": False, "required": r, "value": None, "evidence": [], "method": ""} for f, r in specs(flow, kind)}
    source = dict(zip(SOURCE, (stage01_file, original_file, kind, hint), strict=True))
    return {"source": source, "generated_at": now or datetime.datetime.now().isoformat(timespec="seconds"), "fields": fields, "missing_required_fields": [], "warnings": []}


def prompt(flow: str, kind: str, text: str, filled: dict) -> str:
    """What is asked: JSON alone, the template's keys, nothing guessed."""
    rules = [
        f"Extract the fields of one document ({flow}, {kind}) from its text. Answer with one JSON object and nothing else.",
        "Keep every key of the template, add none, and leave 'source' and 'required' as they are.",
        "Take values from the text only. What it doesn't say has present=false, value=null, evidence=[].",
        "method is a short word for how a value was found.",
    ]
    if told := GUIDE[flow].get("bl" if kind == "hbl" else kind):
        rules += ["Look for:", *[f"- {x}" for x in told]]
    if "incoterm" in filled["fields"]:
        rules.append(f"incoterm is one of {', '.join(INCOTERMS)}, without punctuation and place.")
    return "\n".join([*rules, "", "TEMPLATE", json.dumps(filled, ensure_ascii=False, indent=1), "", "TEXT", text or ""])


def ask(docs: DataFrame, flow: str, client: Callable[[str], str]) -> DataFrame:
    """docs (run_id, doc_id, original_file, doc_kind, text) with the client's `answer`; a client that fails gives an `error`."""

    def run(batches):
        for b in batches:
            answers, errors = [], []
            for doc, name, kind, text in zip(b["doc_id"], b["original_file"], b["doc_kind"], b["text"], strict=True):
                try:
                    answers.append(client(prompt(flow, kind, text, template(flow, kind, doc, name))))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  kept as a row
                    answers.append(None)
                    errors.append(f"the model's client failed: {e}")
            yield pd.DataFrame({c: b[c] for c in ("run_id", "doc_id", "original_file", "doc_kind")} | {"answer": answers, "error": errors})

    cols = docs.select("run_id", "doc_id", "original_file", "doc_kind", "text")
    return cols.mapInPandas(run, "run_id long, doc_id string, original_file string, doc_kind string, answer string, error string")


def salvage(answer: Column) -> Column:
    """The JSON object of an answer, as VARIANT: the answer itself, without its code fence, or from the first { to the last }; else null."""
    s = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+$", "")
    bare = F.when(s.startswith("```"), F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", "")).otherwise(s)
    braces = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    as_object = lambda x: F.when(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.try_parse_json(x))
    return F.coalesce(*[as_object(x) for x in (s, bare, braces)])


def clean_warnings(v: Column) -> Column:
    """A list of warnings as texts, stripped, empty ones left out; what is no list has none."""
    texts = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(texts, lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != ""))


def _kind_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def validate(answers: DataFrame, flow: str, kind: str) -> DataFrame:
    """Answers of one kind with `error` (null: good), `fields` (map of meta data), `missing` and `warnings`.

    Keys must be those of the template, `present` and `required` booleans,
    `required` unchanged, `evidence` a list or null, `method` a text that is not
    blank. The first error found is given.
    """
    want = specs(flow, kind)
    d = answers.withColumn("_object", salvage(F.col("answer")))
    has = _kind_of(F.col("_object"), "$.fields").isNotNull()
    d = d.withColumn("_fields", F.when(has, F.try_variant_get("_object", "$.fields", "variant")).otherwise(F.col("_object")))
    keys = lambda v: F.coalesce(F.json_object_keys(v.cast("string")), F.array().cast("array<string>"))
    names = F.array(*[F.lit(f) for f, _ in want]).cast("array<string>")
    d = d.withColumn("_keys", F.when(F.schema_of_variant("_fields").startswith("OBJECT"), keys(F.col("_fields"))))
    lists = lambda x: F.concat(F.lit("["), F.array_join(F.array_sort(x), ", "), F.lit("]"))
    gone, more = F.array_except(names, F.col("_keys")), F.array_except(F.col("_keys"), names)
    error = F.when(F.btrim(F.coalesce("answer", F.lit(""))) == "", "the answer is empty").when(F.col("_object").isNull(), "the answer is no JSON object").when(F.col("_keys").isNull(), "the answer has no object of fields")
    error = error.when((F.size(gone) > 0) | (F.size(more) > 0), F.concat(F.lit(f"fields of {kind} differ: missing="), lists(gone), F.lit(" extra="), lists(more)))
    meta = F.array(*[F.lit(m) for m in META])
    # Fields are data: one expression over (field, required), however many a kind has.
    d = d.withColumn("_map", F.try_variant_get("_fields", "$", "map<string,variant>"))
    rows = F.expr("array(" + ", ".join(f"struct('{f}' AS field, {str(required).lower()} AS required)" for f, required in want) + ")") if want else F.array().cast("array<struct<field:string,required:boolean>>")

    def of_field(r: Column) -> Column:
        return let(F.try_element_at("_map", r["field"]), lambda at: let(F.struct(at.alias("at"), F.try_variant_get(at, "$", "map<string,variant>").alias("m")), lambda x: judged(r, x)))

    def judged(r: Column, x: Column) -> Column:
        own, m = F.map_keys(x["m"]), lambda k: F.try_element_at(x["m"], F.lit(k))
        kind_ = lambda k: F.coalesce(F.schema_of_variant(m(k)), F.lit(""))
        name = lambda text: F.concat(F.lit(text.partition("@")[0]), r["field"], F.lit(text.partition("@")[2]))
        gone_, more_ = F.array_except(meta, own), F.array_except(own, meta)
        method = F.btrim(F.try_variant_get(m("method"), "$", "string"))
        bad = F.when(~F.coalesce(F.schema_of_variant(x["at"]).startswith("OBJECT"), F.lit(False)), name("field @ is no object"))
        bad = bad.when((F.size(gone_) > 0) | (F.size(more_) > 0), F.concat(name("keys of field @ differ: missing="), lists(gone_), F.lit(" extra="), lists(more_)))
        bad = bad.when(kind_("present") != "BOOLEAN", name("present of field @ is no boolean")).when(kind_("required") != "BOOLEAN", name("required of field @ is no boolean"))
        bad = bad.when(F.try_variant_get(m("required"), "$", "boolean") != r["required"], name("required of field @ was changed"))
        bad = bad.when(~(kind_("evidence").startswith("ARRAY") | kind_("evidence").isin("VOID", "")), name("evidence of field @ is no list"))
        bad = bad.when(~F.coalesce((kind_("method") == "STRING") & (method != ""), F.lit(False)), name("method of field @ is no text"))
        number = F.when(kind_("value").rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(m("value"), "$", "double"))
        return F.struct(
            r["field"].alias("field"), r["required"].alias("required"), F.try_variant_get(m("present"), "$", "boolean").alias("present"), F.try_variant_get(m("value"), "$", "string").alias("value"), number.alias("value_num"),
            clean_warnings(m("evidence")).alias("evidence"), method.alias("method"), bad.alias("bad"),
        )

    d = d.select(*d.columns, F.explode(F.array(F.transform(rows, of_field))).alias("_metas"))
    first_bad = F.get(F.filter("_metas.bad", lambda b: b.isNotNull()), F.lit(0))
    before = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    d = d.withColumn("error", F.coalesce(before, error, first_bad))
    d = d.withColumn("fields", F.when(F.col("error").isNull(), F.transform("_metas", lambda m: m.dropFields("bad"))))
    missing = F.transform(F.filter("fields", lambda m: m["required"] & ~m["present"]), lambda m: m["field"])
    if flow == "exportation":
        if kind == "certificate_of_origin":
            # It needs a net weight or an area: said to be there, or with a value.
            there = lambda n: F.exists("fields", lambda m: (m["field"] == n) & (m["present"] | (F.btrim(F.coalesce(m["value"], F.lit(""))).isin("", "[]") == F.lit(False))))
            missing = F.concat(missing, F.when(~there("net_weight_kg") & ~there("total_m2"), F.array(F.lit("net_weight_kg_or_total_m2"))).otherwise(F.array().cast("array<string>")))
        missing = F.array_sort(F.array_distinct(missing))
    notes = F.when(has, clean_warnings(F.try_variant_get("_object", "$.warnings", "variant"))).otherwise(F.array().cast("array<string>"))
    return d.withColumn("missing", missing).withColumn("warnings", F.when(F.col("error").isNull(), notes)).drop("_object", "_fields", "_keys", "_map", "_metas")


def extract_with_model(docs: DataFrame, flow: str, client: Callable[[str], str], fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """As flow.extract_documents, by a model, which is asked once for each document of a known kind.

    Documents whose answer is bad keep its error as a warning; with `fallback`
    the rules read them. Unknown kinds come out as they do by rules.
    """
    from . import flow as flows

    flow = flows.normalize_flow(flow)
    known = list(X.EXPORT if flow == "exportation" else X.IMPORT)
    kinds = docs.withColumn("doc_kind", flows.document_kind(flow, model=True))
    # Answers are written: whatever reads them, the client is not called again.
    answers = written(ask(kinds.where(F.col("doc_kind").isin(known)), flow, client))
    every = None
    for kind in known:
        one = validate(answers.where(F.col("doc_kind") == kind), flow, kind)
        one = one.select("run_id", "doc_id", "original_file", "doc_kind", "error", "fields", "missing", "warnings")
        every = one if every is None else every.unionByName(one)
    every = written(every)
    good, bad = every.where("error IS NULL"), every.where("error IS NOT NULL")
    value = F.col("f.value")
    is_list, is_number = value.startswith("["), F.col("f.value_num").isNotNull()
    fields = good.select("run_id", "doc_id", "doc_kind", F.explode("fields").alias("f")).select(
        "run_id", "doc_id", "doc_kind", "f.field", "f.required", "f.present", F.when(~F.coalesce(is_list, F.lit(False)) & ~is_number, value).alias("value_str"), "f.value_num", F.when(is_list, F.from_json(value, "array<string>")).alias("value_list"), "f.evidence", "f.method",
    )
    columns = ["run_id", "doc_id", "original_file", "doc_kind", "warnings", "missing"]
    out = good.select(*columns).unionByName(flows.unknown_kinds(kinds.where(~F.col("doc_kind").isin(known)), flow).select(*columns))
    if fallback:
        d, f = flows.extract_documents(docs.join(bad.select("run_id", "doc_id"), ["run_id", "doc_id"], "left_semi"), flow)
        return out.unionByName(d.select(*columns)), fields.unionByName(f.select(*fields.columns))
    empty = F.array().cast("array<string>")
    return out.unionByName(bad.select("run_id", "doc_id", "original_file", "doc_kind", F.array("error").alias("warnings"), empty.alias("missing"))), fields
