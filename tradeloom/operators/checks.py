"""Cross-document comparison: alias resolution, pairing, pair, group and rule checks, summaries.

Documents are (run_id, doc_id, doc_kind, original_file); fields are in long form
(run_id, doc_id, field, value_str, value_num, value_list), blank ones left out.
Documents and fields are dealt by run_id once, and the fields of a document are
put into one map; all that follows - pairs, groups, rules - joins and groups by
run_id and needs no further exchange, whatever the number of runs. The check
specifications are a literal table of a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions.numbers import to_float_export, to_float_import
from ..functions.text import digits_only, let, norm_str_export, norm_str_import, strip

#: The checks of each family of document pairs: name, kind, keys of a, keys of b, tolerances.
_G = ["gross_weight_kg_total_calc", "gross_weight_kg", "gross_weight_total_kg"]
_N = ["net_weight_kg_total_calc", "net_weight_kg", "net_weight_total_kg"]
_NAME, _CNPJ = ["consignee_name", "importer_name"], ["consignee_cnpj", "importer_cnpj"]
_IMPORTER, _IMPORTER_CNPJ = ["importer_name", "consignee_name"], ["importer_cnpj", "consignee_cnpj"]
IMPORT_SPECS = {
    "invoice_vs_packing": [
        ("Invoice vs Packing reference number", "docref", ["invoice_number"], ["invoice_number", "packing_list_number"]),
        ("Consignee name", "string", _IMPORTER, _NAME),
        ("Consignee CNPJ", "cnpj", _IMPORTER_CNPJ, _CNPJ),
        ("Gross weight (kg)", "number", ["gross_weight_kg"], _G),
        ("Net weight (kg)", "number", ["net_weight_kg"], _N),
    ],
    "packing_vs_bl": [("Consignee name", "string", _NAME, _NAME), ("Consignee CNPJ", "cnpj", _CNPJ, _CNPJ), ("Gross weight (kg)", "number", _G, ["gross_weight_kg"])],
    "invoice_vs_bl": [("Consignee name", "string", _IMPORTER, _NAME), ("Consignee CNPJ", "cnpj", _IMPORTER_CNPJ, _CNPJ), ("Gross weight (kg)", "number", ["gross_weight_kg"], ["gross_weight_kg"])],
    "di_vs_invoice": [("Invoice number", "docref_set", ["invoice_numbers", "invoice_number"], ["invoice_number", "packing_list_number"])],
    "di_vs_packing": [("Invoice number", "docref_set", ["invoice_numbers", "invoice_number"], ["invoice_number", "packing_list_number"])],
    "di_vs_base": [
        ("Consignee name", "string", _IMPORTER, _IMPORTER),
        ("Consignee CNPJ", "cnpj", _IMPORTER_CNPJ, _IMPORTER_CNPJ),
        ("Gross weight (kg)", "number", ["gross_weight_kg", "gross_weight_total_kg"], ["gross_weight_kg", "gross_weight_kg_total_calc", "gross_weight_total_kg"]),
        ("Net weight (kg)", "number", ["net_weight_kg", "net_weight_total_kg"], ["net_weight_kg", "net_weight_kg_total_calc", "net_weight_total_kg"]),
    ],
    "di_vs_bl": [("NCM/HS", "ncm_hs", ["ncm", "ncm_or_hs"], ["ncm", "ncm_or_hs"])],
}
#: A licence is checked as a declaration is, under a family of its own.
IMPORT_SPECS |= {f"li_{name[3:]}": specs for name, specs in IMPORT_SPECS.items() if name.startswith("di_")}
_GT, _NT = ["gross_weight_kg_total"], ["net_weight_kg_total"]
EXPORT_SPECS = {
    "invoice_vs_packing": [
        ("Invoice/Packing reference", "docref", ["invoice_number"], ["packing_list_number"]),
        ("Gross weight (kg)", "number", ["gross_weight_kg"], ["gross_weight_kg"]),
        ("Net weight (kg)", "number", ["net_weight_kg"], ["net_weight_kg"]),
        ("NCM", "code_prefix", ["ncm"], ["ncm"]),
        ("Incoterm", "string", ["incoterm"], ["incoterm"]),
        ("Container count", "number", ["container_count"], ["container_count"], 0.0, 0.0),
    ],
    "invoice_vs_draft_bl": [
        ("Incoterm", "string", ["incoterm"], ["incoterm"]),
        ("NCM", "code_prefix", ["ncm"], ["ncm"]),
        ("Exporter CNPJ", "cnpj", ["exporter_cnpj"], ["exporter_cnpj"]),
        ("Exporter name", "string", ["exporter_name"], ["exporter_name"]),
        ("Importer name", "string", ["importer_name"], ["importer_name"]),
        ("Gross weight (kg)", "number", ["gross_weight_kg"], _GT),
        ("Net weight (kg)", "number", ["net_weight_kg"], _NT),
    ],
    "packing_vs_draft_bl": [("NCM", "code_prefix", ["ncm"], ["ncm"]), ("Incoterm", "string", ["incoterm"], ["incoterm"]), ("Gross weight (kg)", "number", ["gross_weight_kg"], _GT), ("Net weight (kg)", "number", ["net_weight_kg"], _NT)],
    "coo_vs_invoice": [
        ("Invoice reference", "docref", ["invoice_number"], ["invoice_number"]),
        ("Exporter name", "string", ["exporter_name"], ["exporter_name"]),
        ("Importer name", "string", ["importer_name"], ["importer_name"]),
        ("Gross weight (kg)", "number", ["gross_weight_kg"], ["gross_weight_kg"]),
        ("Net weight (kg)", "number", ["net_weight_kg"], ["net_weight_kg"]),
    ],
    "container_data_vs_draft_bl": [
        ("Booking number", "docref", ["booking_number"], ["booking_number"]),
        ("Container numbers", "container_set", ["containers"], ["containers"]),
    ],
}
#: Kinds of a role and their rank; families as pairs of roles.
ROLES = {
    "importation": {"invoice": ["invoice", "commercial_invoice"], "packing": ["packing_list", "pl"], "bl": ["bl", "hbl", "bill_of_lading"], "di": ["di", "declaracao_importacao", "declaration_of_importation"], "li": ["li", "licenca_importacao", "import_license"]},
    "exportation": {"invoice": ["commercial_invoice"], "packing": ["packing_list"], "bl": ["draft_bl"], "coo": ["certificate_of_origin"], "container": ["container_data"]},
}
FAMILIES = {
    "importation": [("packing_vs_bl", "packing", "bl"), ("invoice_vs_bl", "invoice", "bl"), *[(f"{x}_vs_{n}", x, y) for x in ("di", "li") for n, y in (("invoice", "invoice"), ("packing", "packing"), ("base", "invoice"), ("base", "packing"), ("base", "bl"), ("bl", "bl"))]],
    "exportation": [("invoice_vs_draft_bl", "invoice", "bl"), ("packing_vs_draft_bl", "packing", "bl"), ("coo_vs_invoice", "coo", "invoice"), ("container_data_vs_draft_bl", "container", "bl")],
}


SPECS = {"importation": IMPORT_SPECS, "exportation": EXPORT_SPECS}


def fields_read(flow: str) -> set[str]:
    """The fields that pair checks and the pairing by references read."""
    return {"invoice_number", "packing_list_number"} | {key for specs in SPECS[flow].values() for s in specs for key in (*s[2], *s[3])}


def check_specs(spark: SparkSession, flow: str) -> DataFrame:
    rows = []
    for family, specs in SPECS[flow].items():
        for i, s in enumerate(specs):
            name, kind, a, b, *tol = s
            rows.append((family, i, name, kind, a, b, *(tol or (1.0, 0.01))))
    return spark.createDataFrame(rows, "family string, check_ord int, check string, kind string, a_keys array<string>, b_keys array<string>, abs_tol double, rel_tol double")


def with_roles(docs: DataFrame, flow: str) -> DataFrame:
    """Role of each document and its rank among the kinds of the role."""
    rows = [(k, role, i) for role, kinds in ROLES[flow].items() for i, k in enumerate(kinds)]
    return docs.join(F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_kind string, role string, kind_rank int")), "doc_kind")


def pair_by_reference(docs: DataFrame, fields: DataFrame, flow: str) -> DataFrame:
    """Invoices and packing lists of a run whose references agree; all of them where none agrees.

    The comparison of references is an equality of keys, so this is an equi-join.
    The fallback is per run: runs without any pair give all their combinations.
    """
    key = C.docref_key_import if flow == "importation" else C.docref_key_export
    keys = {"invoice": ["invoice_number"], "packing": ["packing_list_number", "invoice_number"]}
    refs = fields.where(F.col("field").isin("invoice_number", "packing_list_number")).select("run_id", "doc_id", "field", key(F.col("value_str")).alias("ref"))

    def side(role: str, name: str) -> DataFrame:
        d = docs.where(F.col("role") == role).select("run_id", "doc_id")
        r = refs.select("run_id", "doc_id", "ref", F.array_position(F.array(*[F.lit(k) for k in keys[role]]), F.col("field")).alias("pos")).where("pos > 0")
        first = r.groupBy("run_id", "doc_id").agg(F.min_by("ref", "pos").alias("ref"))
        return d.join(first, ["run_id", "doc_id"], "left").select("run_id", F.col("doc_id").alias(name), F.col("ref"))

    a, b = side("invoice", "a_doc"), side("packing", "b_doc")
    met = a.join(b, ["run_id", "ref"]).select("run_id", "a_doc", "b_doc", F.lit(False).alias("fallback"))
    rest = a.join(met.select("run_id").distinct(), "run_id", "left_anti").join(b.drop("ref"), "run_id")
    return met.unionByName(rest.select("run_id", "a_doc", "b_doc", F.lit(True).alias("fallback")))


def all_pairs(docs: DataFrame, fields: DataFrame, flow: str) -> DataFrame:
    """(run_id, family, a_doc, b_doc) of all families."""
    out = pair_by_reference(docs, fields, flow).select("run_id", F.lit("invoice_vs_packing").alias("family"), "a_doc", "b_doc")
    fam = docs.sparkSession.createDataFrame(FAMILIES[flow], "family string, role string, b_role string")
    a = docs.select("run_id", F.col("doc_id").alias("a_doc"), "role").join(F.broadcast(fam), "role")
    b = docs.select("run_id", F.col("doc_id").alias("b_doc"), F.col("role").alias("b_role"))
    return out.unionByName(a.join(b, ["run_id", "b_role"]).select("run_id", "family", "a_doc", "b_doc"))


def with_fields(docs: DataFrame, fields: DataFrame | None) -> DataFrame:
    """docs with `m`, the map of a document's fields, dealt by run_id. A field stands once in a document.

    Documents that have their map already (fields is None) stay as they are dealt.
    Evidence goes with the values where the fields have some.
    """
    if fields is None:
        return docs
    evidence = F.col("evidence") if "evidence" in fields.columns else F.lit(None).cast("array<string>")
    # Both sides are dealt together, so that documents without fields stay and one exchange is enough.
    d = docs.select("run_id", "doc_id", F.struct(*docs.columns).alias("d"), F.lit(None).alias("f"))
    f = F.struct("field", F.struct("value_str", "value_num", "value_list", evidence.alias("evidence")).alias("v"))
    f = fields.select("run_id", "doc_id", F.lit(None).alias("d"), f.alias("f"))
    both = d.unionByName(f).repartition("run_id").groupBy("run_id", "doc_id").agg(F.max("d").alias("d"), F.map_from_entries(F.collect_list("f")).alias("m"))
    return both.where("d IS NOT NULL").select("d.*", "m")


def first_lines(evidence: Column) -> Column:
    """The lines of evidence that a check carries: two, or none."""
    return F.coalesce(F.slice(evidence, 1, 2), F.array().cast("array<string>"))


def resolve(m: Column, keys: Column) -> Column:
    """Of a map of fields the first key that is there, with its value: struct(field, v), or null."""
    found = F.transform(keys, lambda k: F.struct(k.alias("field"), F.try_element_at(m, k).alias("v")))
    return F.get(F.filter(found, lambda f: f["v"].isNotNull()), F.lit(0))


def label_of(name: Column, kind: Column) -> Column:
    """How a document is named in pairs and groups: by its original file, else by its kind."""
    blank = lambda x: F.when(F.btrim(x) != "", x)
    return F.coalesce(blank(name), blank(kind), F.lit("doc"))


def container_numbers(x: Column) -> Column:
    """Sorted distinct container numbers of a list of texts, each a text or JSON of any depth.

    An object that names its container_number stands for that alone; else all
    its values are looked through, as are those of lists, and texts for numbers.
    JSON is walked level by level over VARIANT, as many levels as it has brackets.
    """
    in_text = lambda s: F.regexp_extract_all(F.upper(s), F.lit(r"\b([A-Z]{4}[0-9]{7})\b"), F.lit(1))
    as_text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    named = lambda v: F.nullif(F.upper(strip(F.try_variant_get(v, "$.container_number", "string"))), F.lit(""))
    no_variants = F.array().cast("array<variant>")

    def found(v: Column) -> Column:
        return F.coalesce(F.when(named(v).isNotNull(), F.array(named(v))), in_text(as_text(v)), F.array().cast("array<string>"))

    def below(v: Column) -> Column:
        within = F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), no_variants)
        return F.when(named(v).isNotNull(), no_variants).otherwise(F.filter(within, lambda c: c.isNotNull()))

    def walk(text: Column, v: Column) -> Column:
        depth = F.length(F.regexp_replace(text, r"[^\[{]", ""))
        start = F.struct(F.array(v).alias("level"), F.array().cast("array<string>").alias("found"))
        step = lambda a, _: F.struct(F.flatten(F.transform(a["level"], below)).alias("level"), F.concat(a["found"], F.flatten(F.transform(a["level"], found))).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), depth), start, step, lambda a: a["found"])

    def of(text: Column) -> Column:
        nested = F.when(text.rlike(r"^\s*[\[{]"), F.try_parse_json(text))
        return let(nested, lambda v: F.when(v.isNotNull(), walk(text, v)).otherwise(in_text(text)))

    texts = F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda t: t.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(F.transform(texts, of))))


def pair_checks(docs: DataFrame, fields: DataFrame | None, flow: str) -> DataFrame:
    """One row per pair and check: status (match, divergent, skipped), reason, keys used and values."""
    spark = docs.sparkSession
    d = with_fields(with_roles(docs, flow), fields)
    key = C.docref_key_import if flow == "importation" else C.docref_key_export
    ref = lambda *keys: key(resolve(F.col("m"), F.array(*[F.lit(k) for k in keys]))["v"]["value_str"])
    role = F.col("role")
    d = d.withColumn("ref", F.when(role == "invoice", ref("invoice_number")).when(role == "packing", ref("packing_list_number", "invoice_number")))
    side = lambda d, s: d.select("run_id", F.col("doc_id").alias(f"{s}_doc"), F.col("role").alias(f"{s}_role"), F.col("m").alias(f"{s}_m"), label_of(F.col("original_file"), F.col("doc_kind")).alias(f"{s}_label"), F.col("ref").alias(f"{s}_ref"), *(c for c in d.columns if c == "any"))
    # Invoices and packing lists pair by their references; in a run where none agrees, all do. Told by the documents, not by the wider pairs.
    of = lambda r: F.collect_set(F.when(role == r, F.col("ref"))).over(W.partitionBy("run_id"))
    a, b = side(d.withColumn("any", F.arrays_overlap(of("invoice"), of("packing"))), "a"), side(d, "b")
    families = {}
    for family, x, y in [("invoice_vs_packing", "invoice", "packing"), *FAMILIES[flow]]:
        families.setdefault(f"{x}|{y}", []).append(family)
    known = F.create_map(*[c for k, names in families.items() for c in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
    # Roles are no keys of the join: by run_id alone the documents are dealt already.
    roles = F.concat_ws("|", "a_role", "b_role")
    pairs = a.join(b, (a["run_id"] == b["run_id"]) & F.map_contains_key(known, roles)).drop(b["run_id"]).withColumn("family", F.explode(F.try_element_at(known, roles)))
    pairs = pairs.where((F.col("family") != "invoice_vs_packing") | F.coalesce(F.col("a_ref") == F.col("b_ref"), F.lit(False)) | ~F.col("any"))
    full = pairs.join(F.broadcast(check_specs(spark, flow)), "family")
    sides = ("a", "b")
    keep = ["family", "a_label", "b_label", "a_doc", "b_doc", "check_ord", "check", "kind", "abs_tol", "rel_tol"]
    numeric, boxes = F.col("kind") == "number", F.col("kind") == "container_set"
    to_float = to_float_import if flow == "importation" else to_float_export
    compared = C.IMPORT if flow == "importation" else C.EXPORT
    none = F.array().cast("array<string>")

    def by_kind(f) -> Column:
        out = None
        for kind, how in compared.items():
            out = (F if out is None else out).when(F.col("kind") == kind, f(how))
        return out

    def told(s: str) -> list[Column]:
        v = F.col(f"{s}.v")
        text = F.coalesce(v["value_str"], v["value_num"].cast("string"), F.array_join(v["value_list"], ","))
        return [F.col(f"{s}.field").alias(f"{s}_key"), text.alias(f"{s}_text"), v["value_num"].alias(f"{s}_num"), v["value_str"].alias(f"{s}_str"), F.coalesce(v["value_list"], F.array(v["value_str"])).alias(f"{s}_items"), F.coalesce(first_lines(v["evidence"]), none).alias(f"evidence_{s}")]

    # Values, their texts and the forms that are compared are columns of three selects, each made once for a row and side.
    # They are not put together into one select, whose code would be too long to be compiled.
    full = full.select("run_id", *keep, *[resolve(F.col(f"{s}_m"), F.col(f"{s}_keys")).alias(s) for s in sides])
    full = full.select("run_id", *keep, *[c for s in sides for c in told(s)])
    form = lambda s: by_kind(lambda how: how[0](F.col(f"{s}_text"))).alias(f"{s}_form")
    number = lambda s: F.when(numeric, F.coalesce(f"{s}_num", to_float(F.col(f"{s}_str")))).alias(f"{s}_number")
    numbers = lambda s: (F.when(boxes, container_numbers(F.col(f"{s}_items"))) if flow != "importation" else F.lit(None).cast("array<string>")).alias(f"{s}_boxes")
    full = full.select("run_id", *keep, *[x for s in sides for x in (f"{s}_key", f"{s}_text", f"{s}_items", f"evidence_{s}", form(s), number(s), numbers(s))])
    # A generator between, or a filter on what follows would be moved down and make all of it anew.
    # The run stays outside of it, as what follows knows by it how rows are dealt.
    full = full.select("run_id", F.explode(F.array(F.struct(*full.drop("run_id").columns))).alias("row")).select("run_id", "row.*")
    x, y = F.col("a_form"), F.col("b_form")
    close = by_kind(lambda how: how[1](x, y))
    close = close.when(F.col("kind") == "docref_set", C.docref_set_close(F.col("a_items"), F.col("b_items")))
    close = close.when(boxes, F.col("a_boxes") == F.col("b_boxes"))
    a, b = (F.col(f"{s}_key").isNull() | (boxes & (F.size(F.col(f"{s}_boxes")) == 0)) for s in sides)
    m, n = F.col("a_number"), F.col("b_number")
    reason = F.when(a & b, "missing_on_both").when(a, "missing_on_a").when(b, "missing_on_b").when(numeric & (m.isNull() | n.isNull()), "not_numeric")
    ok = F.when(numeric, C.number_close(m, n, F.col("abs_tol"), F.col("rel_tol"))).otherwise(F.coalesce(close, F.lit(False)))
    note = F.when(F.col("kind") == "ncm_hs", C.part_note(x, y)).when(boxes & ~a & ~b, F.when(ok, "set_equal").otherwise("set_differ"))
    return full.select(
        "run_id", "family", F.concat("family", F.lit(" | "), "a_label", F.lit(" <> "), "b_label").alias("pair"), "a_doc", "b_doc", "check_ord", "check",
        F.when(reason.isNotNull(), "skipped").when(ok, "match").otherwise("divergent").alias("status"),
        reason.alias("reason"), F.col("a_key").alias("a_key_used"), F.col("b_key").alias("b_key_used"),
        F.coalesce(m.cast("string"), F.col("a_text")).alias("a_value"), F.coalesce(n.cast("string"), F.col("b_text")).alias("b_value"),
        note.alias("note"), F.coalesce(note.startswith("partial_hs_"), F.lit(False)).alias("warning"), "evidence_a", "evidence_b",
    )


def first_docs(docs: DataFrame, flow: str) -> DataFrame:
    """The first document of each run and role, by kind, then name."""
    w = W.partitionBy("run_id", "role").orderBy("kind_rank", "original_file", "doc_id")
    return with_roles(docs, flow).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def group_check(docs: DataFrame, fields: DataFrame | None, flow: str, roles: list[str], keys: list[str] | dict[str, list[str]], mode: str) -> DataFrame:
    """Equality of a value over the first document of each role; missing if any lacks it.

    keys: the aliases, the same for all roles or by role. Every document with a
    value to compare is held against the first such; tax numbers without a digit
    are none. Items carry document, key and value.
    """
    by = keys if isinstance(keys, dict) else {r: keys for r in roles}
    d = with_fields(first_docs(docs, flow).where(F.col("role").isin(roles)), fields)
    used = None
    for r in roles:
        used = (F if used is None else used).when(F.col("role") == r, F.array(*[F.lit(k) for k in by[r]]))
    d = d.withColumn("used", resolve(F.col("m"), used))
    v = F.col("used.v")
    text = F.coalesce(v["value_str"], v["value_num"].cast("string"), F.array_join(v["value_list"], ","))
    rank = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))
    item = F.struct(rank.alias("r"), label_of(F.col("original_file"), F.col("doc_kind")).alias("doc"), "doc_kind", F.col("used.field").alias("key_used"), text.alias("v"), F.coalesce(first_lines(v["evidence"]), F.array().cast("array<string>")).alias("evidence"))
    g = d.select("run_id", item.alias("item")).groupBy("run_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    close, plain = {
        "shipper": (C.shipper_close, lambda x: x),
        "cnpj": (C.cnpj_close, digits_only),
        "string": (C.string_close_import if flow == "importation" else C.string_close_export, norm_str_import if flow == "importation" else norm_str_export),
    }[mode]
    lacking = F.filter("items", lambda x: x["v"].isNull())
    said = F.filter("items", lambda x: F.coalesce(plain(x["v"]), F.lit("")) != "")
    g = g.select("run_id", "items", lacking.alias("lacking"), said.alias("said"))
    equal = F.forall("said", lambda x: close(x["v"], F.get("said", F.lit(0))["v"]))
    status = F.when((F.size("lacking") > 0) | (F.size("said") == 0), "missing").when(equal, "match").otherwise("divergent")
    names = F.array_join(F.transform("lacking", lambda x: x["doc"]), ", ")
    same, other = ("all_equal", "digits_differ") if mode == "cnpj" else ("all_equal_soft", "values_differ")
    reason = F.when(F.size("lacking") > 0, F.concat(F.lit("missing_in: "), names)).when(F.size("said") == 0, "no_values_found").when(equal, same).otherwise(other)
    return g.select("run_id", status.alias("status"), reason.alias("reason"), F.array_join(F.transform("lacking", lambda x: x["doc_kind"]), ",").alias("missing"), F.size("items").alias("n_docs"), "items")


def freight_rule(docs: DataFrame, fields: DataFrame | None, flow: str) -> DataFrame:
    """Delivery term of every invoice of a run against the freight mode of every bill of lading."""
    d = with_fields(with_roles(docs, flow), fields)
    export = flow != "importation"
    pick = lambda role, s, names: d.where(F.col("role") == role).select("run_id", F.col("doc_id").alias(f"{s}_doc"), label_of(F.col("original_file"), F.col("doc_kind")).alias(f"{s}_label"), resolve(F.col("m"), F.array(*[F.lit(n) for n in names]))["v"].alias(s))
    # Aliases of the two fields, the first that is there counts.
    a = pick("invoice", "a", ["incoterm", "incoterms"])
    b = pick("bl", "b", ["freight_terms", "freight_mode", "freight", "freight_term"])
    # A generator between, as for pairs: the two values are used many times below.
    none = F.array().cast("array<string>")
    held = F.struct("a_doc", "b_doc", "a_label", "b_label", F.col("a.value_str").alias("term"), F.col("b.value_str").alias("said"), first_lines(F.col("a.evidence")).alias("evidence_a"), first_lines(F.col("b.evidence")).alias("evidence_b"))
    j = a.join(b, "run_id").select("run_id", F.explode(F.array(held)).alias("row")).select("run_id", "row.*")
    mode = F.upper(F.btrim("said")) if export else C.freight_mode(F.col("said"))
    want = C.expected_freight(F.col("term"), export)
    lacks = F.col("term").isNull() | F.col("said").isNull()
    reason = F.when(lacks, "missing_incoterm_or_freight_mode").when(want.isNull(), "incoterm_not_in_mapping")
    status = F.when(reason.isNotNull(), "skipped").when(want == mode, "match").otherwise("divergent")
    pair = F.concat("a_label", F.lit(" <> "), "b_label")
    return j.select("run_id", "a_doc", "b_doc", pair.alias("pair"), "term", F.when(~lacks, want).alias("expected"), F.when(lacks, F.col("said")).otherwise(mode).alias("freight"), status.alias("status"), reason.alias("reason"), "evidence_a", "evidence_b")


def stage_summary(pair_rows: DataFrame, group_rows: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Per run the counts of the three buckets, a row for each run of any."""
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    p = pair_rows.groupBy("run_id").agg(F.count("*").alias("pair_total"), n("match", "pair_matches"), n("divergent", "pair_divergences"), n("skipped", "pair_skipped"))
    g = group_rows.groupBy("run_id").agg(F.count("*").alias("group_total"), n("divergent", "group_divergences"), n("missing", "group_missing"))
    r = rule_rows.groupBy("run_id").agg(F.count("*").alias("rule_total"), n("divergent", "rule_divergences"), n("skipped", "rule_skipped"))
    return p.join(g, "run_id", "full").join(r, "run_id", "full").na.fill(0)


def bucket_summary(rows: DataFrame) -> DataFrame:
    """The counts of stage_summary from rows in one form, a row for each run of any."""
    n = lambda bucket, status, name: F.count_if((F.col("bucket") == bucket) & (F.col("status").isin(status) if status else F.lit(True))).alias(name)
    return rows.groupBy("run_id").agg(
        n("pair", [], "pair_total"), n("pair", ["match"], "pair_matches"), n("pair", ["divergent"], "pair_divergences"), n("pair", ["skipped"], "pair_skipped"),
        n("group", [], "group_total"), n("group", ["divergent"], "group_divergences"), n("group", ["missing"], "group_missing"),
        n("rule", [], "rule_total"), n("rule", ["divergent"], "rule_divergences"), n("rule", ["skipped"], "rule_skipped"),
    )


def summary(checks: DataFrame, *by: str) -> DataFrame:
    return checks.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "match").alias("matches"), F.count_if(F.col("status") == "divergent").alias("divergences"), F.count_if(F.col("status") == "skipped").alias("skipped"))
