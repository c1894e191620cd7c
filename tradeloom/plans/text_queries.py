"""Queries of cleaning, classification, search and extraction, with their DuckDB counterparts.

Shipments are rendered to document text and read back by the extractors; the
counterpart selects the columns that the text was made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..sources.tables import table
from .trade import SQL as TRADE
from .trade import shipments

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_c, _l = F.col, F.lit


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query("clean_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text("text")).alias("digest"))


@query("line_split", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_lines FROM documents")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines("text")).cast("long").alias("n_lines"))


@query("join_pages", "SELECT conv_id, md5(string_agg(trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text, ' ' || chr(10)) <> '')) AS digest FROM conversations GROUP BY conv_id")
def join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    return X.join_pages(pages, "conv_id").select("conv_id", F.md5("text").alias("digest"))


@query("page_quality", "SELECT conv_id, count(*) AS pages, count_if(length(trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ' || chr(10))) >= 80) AS direct, count_if(NOT length(trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ' || chr(10))) >= 80) AS needs_ocr FROM conversations GROUP BY conv_id")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = F.length(T.clean_text("text")) >= 80
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"), F.count_if(direct).alias("direct"), F.count_if(~direct).alias("needs_ocr"))


@query("phones", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '\+?[0-9][0-9\s().\-]{7,}[0-9]'), lambda p: len(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 8 AND 16), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))))), '|') AS phones FROM documents")
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.phones(F.col("text"), F.array()), "|").alias("phones"))


@query("hint_resolution", "SELECT d.doc_id, CASE CASE toxic WHEN 1 THEN ' BL ' WHEN 0 THEN 'Commercial_Invoice' END WHEN ' BL ' THEN 'bl' WHEN 'Commercial_Invoice' THEN 'invoice' ELSE 'unknown' END AS kind FROM documents d LEFT JOIN labels l USING (doc_id)")
def hint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = table(spark, sf_dir, "labels").select("doc_id", F.when(_c("toxic") == 1, " BL ").when(_c("toxic") == 0, "Commercial_Invoice").alias("hint"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(hints, "doc_id", "left")
    return docs.select("doc_id", F.coalesce(X.hint_kind(F.col("hint"), "importation"), X.detect_kind_import(F.lit(""))).alias("kind"))


@query("detect_kind_import", f"WITH {TRADE} SELECT k, ['hbl', 'packing_list', 'di', 'li', 'invoice', 'bl', 'unknown'][k % 7 + 1] AS kind FROM trade")
def detect_kind_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["House Bill of", "Packing  List and INVOICE", "Conferencia DI of invoice", "NR. LI 7 invoice", "Commercial invoice", "Bill of lading", "nothing"]
    t = F.concat(F.get(F.array(*[_l(w) for w in words]), (_c("k") % 7).cast("int")), _l(" "), _c("cnpj_a"))
    return shipments(spark, sf_dir).select("k", X.detect_kind_import(t).alias("kind"))


@query("infer_kind_export", f"WITH {TRADE} SELECT k, ['certificate_of_origin', 'draft_bl', 'packing_list', 'commercial_invoice', 'container_data', 'unknown'][k % 6 + 1] AS kind FROM trade")
def infer_kind_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["Certificate   of Origin invoice", "the carrier bears the FREIGHT", "packing list of invoice", "an invoice", "booking of a container", "nothing"]
    t = F.concat(F.get(F.array(*[_l(w) for w in words]), (_c("k") % 6).cast("int")), _l(" "), _c("cnpj_a"))
    return shipments(spark, sf_dir).select("k", X.infer_kind_export(_l("file.pdf"), t).alias("kind"))


@query("find_incoterm", f"WITH {TRADE} SELECT k, CASE WHEN k % 5 = 0 THEN 'FOB' ELSE term END AS import_term, CASE WHEN term <> 'DAT' THEN term END AS export_term FROM trade")
def find_incoterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(_c("k") % 5 == 0, "free on  board\n").otherwise(""), _l("INCOTERMS\nhere: "), F.lower("term"))
    d = shipments(spark, sf_dir).select("k", t.alias("t")).withColumn("ls", T.lines_collapsed("t"))
    return d.select("k", X.incoterm_import(_c("t"), _c("ls")).alias("import_term"), X.incoterm_export(_c("t"), _c("ls")).alias("export_term"))


@query("section_slice", f"WITH {TRADE} SELECT k, imp_a AS inside, CAST(NULL AS VARCHAR) AS outside FROM trade")
def section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(_l("CIDADE: X\nINFORMACOES - IMPORTADOR\nNOME: "), _c("imp_a"), _l("\nINFORMACOES - CARGA\nPESO: 1"))
    d = shipments(spark, sf_dir).select("k", T.lines(t).alias("ls"))
    part = T.section(_c("ls"), "INFORMACOES - IMPORTADOR", "^INFORMA")
    return d.select("k", X.label("NOME", ahead=3)(_l(""), part).alias("inside"), X.label("PESO", ahead=3)(_l(""), part).alias("outside"))


def _lines(*parts):
    return F.concat_ws("\n", *[p if not isinstance(p, tuple) else F.concat(*[_l(x) if isinstance(x, str) else x for x in p]) for p in parts])


def _fixed(x, places: int = 3):
    """A number with a decimal comma and thousands points: 1.234,000."""
    s = F.regexp_replace(F.format_number(x, places), "[.]", "#")
    return F.replace(F.replace(s, _l(","), _l(".")), _l("#"), _l(","))


def _extract(name: str, flow: str, kind: str, render, fields: dict[str, str], post=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = shipments(spark, sf_dir).where(F.col("net_a").isNotNull()).select("k", render().alias("text"))
        x = X.extract_kind(docs, flow, kind)
        return (post(x) if post else x).select("k", *fields)

    QUERIES[name] = run
    ORACLES[name] = f"WITH {TRADE} SELECT k, {', '.join(f'{v} AS {f}' for f, v in fields.items())} FROM trade WHERE net_a IS NOT NULL"


_shape = lambda: F.regexp_replace("cnpj_a", r"^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")
_extract("extract_invoice_import", "importation", "invoice", lambda: _lines(_l("COMMERCIAL INVOICE"), ("INVOICE NO: ", _c("inv_a")), ("DATE: ", _c("day")), _l("PAYMENT TERMS\n90 DAYS"), ("BILL TO\n", _c("imp_a")), ("CNPJ: ", _shape()), _l("CURRENCY: USD"), ("INCOTERM ", _c("term")), ("NET WEIGHT: ", _fixed(_c("net_a"), 2), " KGS"), ("GROSS WEIGHT: ", _fixed(_c("net_a") + 5, 2), " KGS"), _l("* M1 2 UNITS @1,000 -. 2,000 -.")),
         {"invoice_number": "inv_a", "invoice_date": "day", "payment_terms": "'90 DAYS'", "importer_name": "imp_a", "importer_cnpj": "cnpj_a", "currency": "'USD'", "incoterm": "term", "net_weight_kg": "net_a", "gross_weight_kg": "net_a + 5", "items": "1::BIGINT", "amount": "2000.0::DOUBLE"},
         lambda x: x.withColumn("items", F.size("line_items").cast("long")).withColumn("amount", F.col("line_items")[0]["amount"]))
_extract("extract_packing_import", "importation", "packing_list", lambda: _lines(("PACKING LIST ", F.regexp_replace("inv_a", "^INV", "DN")), _l("* MODEL: MOD1"), _l("1 - 3 3 CARTONS @199 @264 1,2 3,6"), _l("597 792"), ("TOTAL : 3 CARTONS ", _fixed(_c("net_a"), 2), " ", _fixed(_c("net_a") * 2, 2), " 3.772"), ("CNPJ ", _shape())),
         {"invoice_number": "'DN-' || substr(inv_a, 5)", "importer_cnpj": "cnpj_a", "packages_total": "3::BIGINT", "net_weight_kg": "net_a", "gross_weight_kg": "net_a * 2", "measurement_total_m3": "3.772::DOUBLE", "model": "'MOD1'", "item_net": "597.0::DOUBLE", "sum_packages": "3::BIGINT"},
         lambda x: x.withColumn("model", F.col("items")[0]["model"]).withColumn("item_net", F.col("items")[0]["net_weight_kg"]).withColumn("sum_packages", F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["packages"])))
_extract("extract_bl_import", "importation", "bl", lambda: _lines(_l("BILL OF LADING"), _l("SHIPPER"), ("", _c("exp_a"), " 258255821A"), _l("SHIPPER SA\nCNPJ 11.222.333/0001-44"), _l("CONSIGNEE"), ("", _c("imp_a"), " Received by the Carrier"), _l("RUA 1, TEL 99"), ("CNPJ ", _shape()), _l("NOTIFY PARTY\nSAME AS CONSIGNEE\nOTHER SA\nCNPJ 99.888.777/0001-66"), ("NCM ", F.left("ncm_a", _l(6))), _l("PORT OF LOADING: TEL 5"), _l("PORT OF LOADING: GENOVA"), _l("PORT OF LOADING: SANTOS"), _l("PORT OF DISCHARGE\nEMAIL a\nNAVEGANTES"), ("GROSS WEIGHT\n", _fixed(_c("net_a"), 2), " KG ", _fixed(_c("net_a"), 2), " KG"), _l("53,772 CBM"), ("FREIGHT ", _c("freight"))),
         {"shipper_name": "exp_a", "importer_name": "imp_a", "importer_cnpj": "cnpj_a", "ncm": "left(ncm_a, 6)", "gross_weight_kg": "net_a * 2", "freight_terms": "freight", "freight_term": "freight", "measurement_m3": "53772.0::DOUBLE", "notify_party": "'SAME AS CONSIGNEE'", "port_of_loading": "'SANTOS'", "port_of_discharge": "'NAVEGANTES'"})
_extract("extract_di", "importation", "di", lambda: _lines(_l("CONFERENCIA DI"), ("IMPORTADOR\n", _c("imp_a")), ("CNPJ ", _shape()), ("FATURA COMERCIAL ", _c("inv_a"), " 12 77 ", _c("inv_a")), _l("NOSSA REFERÊNCIA: A-1"), _l("TIPO DE DECLARAÇÃO\nCONSUMO"), _l("URF DESPACHO\nsem\n0817800"), _l("INFORMAÇÕES - IMPORTADOR"), _l("CIDADE/UF: ITAJAI"), _l("INFORMAÇÕES - CARGA"), ("NCM ", _c("ncm_a")), ("PESO BRUTO: ", _fixed(_c("net_a"), 2), " KG")),
         {"importer_name": "imp_a", "importer_cnpj": "cnpj_a", "invoice_number": "inv_a", "n_invoices": "1::BIGINT", "reference_internal": "'A-1'", "declaration_type": "'CONSUMO'", "dispatch_urf": "'0817800'", "importer_city_uf": "'ITAJAI'", "ncm": "ncm_a", "gross_weight_kg": "net_a"},
         lambda x: x.withColumn("n_invoices", F.size("invoice_numbers").cast("long")))
_extract("extract_li", "importation", "li", lambda: _lines(_l("CONFERENCIA LI"), ("NOME DO IMPORTADOR: ", _c("imp_a")), ("CNPJ ", _shape()), ("NR LI: 26/", _c("k").cast("string"), "-1"), ("INVOICE NO ", _c("inv_a")), _l("PAIS DE ORIGEM: CHINA"), _l("EXPORTADOR / FABRICANTE / PRODUTOR"), _l("ENDEREÇO: RUA 1"), _l("INFORMA"), ("NCM ", _c("ncm_a")), _l("MOEDA NEGOCIADA\nDOLAR"), ("PESO LÍQUIDO ", _fixed(_c("net_a"), 2), " KG"), ("INCOTERM ", _c("term"))),
         {"importer_name": "imp_a", "importer_cnpj": "cnpj_a", "li_number": "'26/' || k || '-1'", "invoice_number": "inv_a", "country_of_origin": "'CHINA'", "exporter_address": "'RUA 1'", "importer_address": "CAST(NULL AS VARCHAR)", "ncm": "ncm_a", "currency": "'DOLAR'", "net_weight_kg": "net_a", "incoterm": "term"})
_extract("extract_invoice_export", "exportation", "commercial_invoice", lambda: _lines(_l("COMMERCIAL INVOICE"), ("INVOICE NR ", _c("inv_a")), _c("day"), _l("PAIS DE ORIGEN BRASIL"), _l("VIA DE TRANSPORTE"), _l("PUERTO DE EMBARQUE"), _l("PUERTO DE DESTINO"), _l("MARITIMO"), _l("SANTOS"), _l("KINGSTON"), _l("PESO BRUTO"), _l("PESO NETO"), _fixed(_c("net_a") + 5), _fixed(_c("net_a")), ("INCOTERMS ", F.when(_c("term") == "DAT", "DAP").otherwise(_c("term"))), _l("MONEDA USD"), ("NCM ", _c("ncm_a")), ("CNTR ", _c("containers").cast("string")), ("", _c("exp_a")), ("CNPJ ", _shape()), ("CONSIGNEE ", _c("imp_a")), _l("COBRANZA A 90 DIAS")),
         {"invoice_number": "inv_a", "invoice_date": "day", "country_of_origin": "'BRASIL'", "transport_mode": "'MARITIMO'", "port_of_loading": "'SANTOS'", "port_of_destination": "'KINGSTON'", "gross_weight_kg": "net_a + 5", "net_weight_kg": "net_a", "incoterm": "CASE term WHEN 'DAT' THEN 'DAP' ELSE term END", "currency": "'US$'", "ncm": "ncm_a", "container_count": "containers", "exporter_cnpj": "cnpj_a", "exporter_name": "exp_a", "importer_name": "imp_a", "payment_terms": "'COBRANZA A 90 DIAS'"})
_extract("extract_packing_export", "exportation", "packing_list", lambda: _lines(("PACKING NR ", _c("inv_b")), _c("day"), ("GROSS WEIGHT ", _fixed(_c("net_a") + 5), " KG"), ("NET WEIGHT\n", _fixed(_c("net_a"))), ("NCM ", _c("ncm_a")), ("CNTR ", _c("containers").cast("string")), ("TEMU", F.lpad((_c("k") % 10000000).cast("string"), 7, "0"), " M1024218 76,98"), ("TEMU", F.lpad((_c("k") % 10000000).cast("string"), 7, "0"), " X9999999 1,0")),
         {"packing_list_number": "inv_b", "packing_date": "day", "gross_weight_kg": "net_a + 5", "net_weight_kg": "net_a", "ncm": "ncm_a", "container_count": "containers", "n_containers": "1::BIGINT", "seal": "'M1024218'", "value_1": "76.98::DOUBLE"},
         lambda x: x.withColumn("n_containers", F.size("containers").cast("long")).withColumn("seal", F.col("containers")[0]["seal"]).withColumn("value_1", F.col("containers")[0]["value_1"]))
_extract("extract_draft_bl", "exportation", "draft_bl", lambda: _lines(_l("BILL OF LADING"), ("FREIGHT ", _c("freight")), ("NCM ", _c("ncm_a")), _l("DUE: ."), ("RUC BR", _c("k").cast("string")), _l("WOODEN PACKAGE: NO"), _l("12 CARTONS"), ("Net Weight: ", _fixed(_c("net_a")), " kg"), ("Gross Weight: ", _fixed(_c("net_a") + 5), " kg"), _l("53,772 CBM"), ("", _c("exp_a")), ("CNPJ ", _shape()), ("", _c("imp_a")), _l("NOTIFY PARTY SOME ONE SA"), _l("PAGE 1\nCLIENTE FINAL SA\nsales@cliente.example"), _l("CONDITIONS OF CARRIAGE"), _l("NET WEIGHT 9 KG")),
         {"freight_mode": "freight", "ncm": "ncm_a", "due": "CAST(NULL AS VARCHAR)", "ruc": "'BR' || k", "wooden_packing": "'NO'", "total_cartons": "12::BIGINT", "net_weight_kg_total": "net_a", "gross_weight_kg_total": "net_a + 5", "cubic_meters_total": "53.772::DOUBLE", "exporter_cnpj": "cnpj_a", "exporter_name": "exp_a", "importer_name": "imp_a", "notify_party_name": "'CLIENTE FINAL SA'"})
_extract("extract_coo", "exportation", "certificate_of_origin", lambda: _lines(_l("CERTIFICATE OF ORIGIN"), ("", _c("exp_a")), ("CONSIGNEE ", _c("imp_a")), ("INVOICE NR ", _c("inv_a")), _c("day"), _l("BY SEA"), ("", _fixed(_c("net_a") + 5), " KGS"), ("", _fixed(_c("net_a")), " KGS"), _l("120,5 M2")),
         {"invoice_number": "inv_a", "certificate_date": "day", "transport_mode": "'BY SEA'", "exporter_name": "exp_a", "importer_name": "imp_a", "net_weight_kg": "net_a", "gross_weight_kg": "net_a + 5", "total_m2": "120.5::DOUBLE"})
_extract("extract_container_data", "exportation", "container_data", lambda: _lines(("FATURA ", _c("inv_a")), ("BOOKING SSZ", F.lpad(_c("k").cast("string"), 7, "0")), _l("TEMU1680211"), _l("M1024218"), _l("2100,000"), _l("30480")),
         {"invoice_number": "inv_a", "booking_number": "'SSZ' || lpad(CAST(k AS VARCHAR), 7, '0')", "container": "'TEMU1680211'", "seal": "'M1024218'", "value_1": "2100.0::DOUBLE", "value_2": "30480.0::DOUBLE"},
         lambda x: x.select("*", F.col("containers")[0]["container_number"].alias("container"), F.col("containers")[0]["seal"].alias("seal"), F.col("containers")[0]["value_1"].alias("value_1"), F.col("containers")[0]["value_2"].alias("value_2")))
