"""Stages of a flow: each from its files alone, all of them in a row, and from the command line.

Every stage reads the files of the one before and writes its own, so that a flow
can be taken up again after any of them. A folder holds any number of runs: the
files of a run lie under its number (files at the top are run 0).

    python -m tradeloom --input IN --output OUT --flow importation [--json]
    python -m tradeloom --stage 3 --flow exportation --param in_dir=... --param out_dir=...
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks as K
from .operators import flow as FL
from .operators import model as M
from .operators import run_report as RR
from .operators.normalise import normalise
from .sources import pages as P
from .sources import stages as S
from .sources.files import write_files
from .sources.tables import written

#: Names of the stages, and the folder of each under the output.
STAGES = {1: "stage_01_text_extract", 2: "stage_02_field_extract", 3: "stage_03_compare", 4: "stage_04_report", 5: "stage_05_debug_report"}
FOLDERS = {1: "stage_01_text", 2: "stage_02_fields", 3: "stage_03_compare", 4: "stage_04_report", 5: "stage_05_debug_report"}
SIDE_CARS = {"hints": "_doc_type_hints.json", "names": "_original_file_names.json"}


@dataclass
class Result:
    """What a whole flow did: over all runs together; `run_results` tells it for each."""

    success: bool
    flow: str
    stages_completed: list[str] = field(default_factory=list)
    output_files: dict[str, str] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    completed_at: str = ""


def _now() -> str:
    return datetime.now().strftime("%Y-%m-%dT%H:%M:%S")


def _plug_in(name: str | None) -> Callable | None:
    """A function named `module:function`."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def stage_01(spark: SparkSession, flow: str, in_dir: str, out_dir: str, read: Callable | str | None = None, ocr: Callable | str | None = None, min_chars: int = 80, ocr_lang: str = "eng+por", ocr_dpi: int = 300) -> dict:
    """PDF files to pages. read and ocr are plug-ins for the libraries at hand, as functions or by name."""
    read, ocr = (_plug_in(x) if isinstance(x, str) else x for x in (read, ocr))
    if read is None:
        raise ValueError("stage 1 needs `read`, a function of a PDF's bytes that gives the text of its pages")
    files = P.read_pdfs(spark, in_dir)
    pages = P.extract_pages(files, read, ocr, int(min_chars))
    side = {k: P.read_side_cars(spark, in_dir, name) for k, name in SIDE_CARS.items()}
    docs = written(S.documents_of_pages(pages, side["names"], side["hints"]))
    n = docs.count()
    if n:
        S.write_stage01(docs, out_dir)
    return {"processed_count": n, "warnings": [] if n else [f"No PDF files found in: {in_dir}"]}


def stage_02(spark: SparkSession, flow: str, in_dir: str, out_dir: str, engine: str | None = None, client: Callable | str | None = None) -> dict:
    """Pages to fields, by rules or by a model behind `client`, a function of a prompt or its name; the engine is a parameter or the environment's."""
    stage01 = S.read_stage01(spark, in_dir)
    docs = S.documents_for_fields(stage01)
    if FL.resolve_engine(engine) == "llm":
        client = _plug_in(client) if isinstance(client, str) else client
        if client is None:
            raise ValueError("the model engine needs `client`, a function of a prompt that gives the answer")
        out, fields = M.extract_with_model(written(docs), flow, client, FL.falls_back())
    else:
        wide = written(FL.extract_wide(docs, flow))
        out, fields = wide.drop("fields"), FL.long_fields(wide)
    n = out.count()
    if not n:
        return {"processed_count": 0, "warnings": [f"No *_extracted.json files found in: {in_dir}"]}
    hints = stage01.select("run_id", F.col("stage01_file").alias("doc_id"), "doc_kind_hint")
    S.write_stage02(out.join(hints, ["run_id", "doc_id"], "left"), fields, out_dir, flow, _now())
    return {"processed_count": n, "warnings": []}


def stage_03(spark: SparkSession, flow: str, in_dir: str, out_dir: str) -> dict:
    """Fields to checks between documents."""
    docs, fields = S.read_stage02(spark, in_dir)
    docs, fields = written(docs), written(fields)
    n = docs.count()
    if not n:
        return {"processed_count": 0, "warnings": [f"No *_fields.json files found in: {in_dir}"]}
    out = FL.compare(docs, fields, flow)
    rows = written(RR.flow_rows(out["pairs"], out["groups"], out["rules"], flow))
    S.write_stage03(rows, K.bucket_summary(rows), docs, out_dir, flow, _now())
    return {"processed_count": n, "warnings": []}


def _reports(spark: SparkSession, stage02_dir: str, stage03_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs, fields = S.read_stage02(spark, stage02_dir)
    rows, summary = normalise(S.read_stage03(spark, stage03_dir))
    return written(docs), written(fields), written(rows), written(summary)


def _write_reports(reports: DataFrame, out_dir: str, base: str, forms: dict) -> None:
    one = F.array(*[F.struct(F.concat(F.col("run_id").cast("string"), F.lit(f"/{base}.{ending}")).alias("name"), body.alias("content")) for ending, body in forms.items()])
    write_files(reports.select(F.explode(one).alias("f")).select("f.*"), out_dir)


def stage_04(spark: SparkSession, flow: str, stage01_dir: str, stage02_dir: str, stage03_file: str, out_dir: str) -> dict:
    """Reports of all runs as JSON, Markdown and HTML."""
    docs, fields, rows, summary = _reports(spark, stage02_dir, stage03_file)
    quality = S.quality(S.read_stage01(spark, stage01_dir))
    reports = written(RR.run_reports(docs, fields, rows, summary, quality, flow))
    now = _now()
    _write_reports(reports, out_dir, S.FILES["stage04"], {"json": RR.as_json(reports, flow, now), "md": RR.as_markdown(flow, now), "html": RR.as_html(flow, now)})
    return {"processed_count": reports.count(), "warnings": []}


def stage_05(spark: SparkSession, flow: str, stage02_dir: str, stage03_file: str, out_dir: str) -> dict:
    """Debug reports of all runs as JSON, Markdown and HTML."""
    docs, fields, rows, summary = _reports(spark, stage02_dir, stage03_file)
    reports = written(RR.debug_reports(docs, fields, rows, summary))
    now = _now()
    _write_reports(reports, out_dir, S.FILES["stage05"], {"json": RR.debug_json(now, flow), "md": RR.debug_markdown(flow, now), "html": RR.debug_html(flow, now)})
    return {"processed_count": reports.count(), "warnings": []}


#: A stage's function and the parameters it cannot do without.
REGISTRY = {
    1: (stage_01, ["in_dir", "out_dir"]), 2: (stage_02, ["in_dir", "out_dir"]), 3: (stage_03, ["in_dir", "out_dir"]),
    4: (stage_04, ["stage01_dir", "stage02_dir", "stage03_file", "out_dir"]), 5: (stage_05, ["stage02_dir", "stage03_file", "out_dir"]),
}


def run_stage(spark: SparkSession, number: int | str, params: dict) -> dict:
    """One stage from its files."""
    flow = FL.normalize_flow(params.get("flow", "importation"))
    try:
        function, required = REGISTRY[int(number)]
    except (KeyError, ValueError):
        raise ValueError(f"Invalid stage number: {number}") from None
    for key in required:
        if key not in params:
            raise ValueError(f"Missing required parameter: {key}")
    return function(spark, flow, **{k: v for k, v in params.items() if k != "flow"})


def run_flow(spark: SparkSession, input_dir: str, output_dir: str, flow: str = "importation", engine: str | None = None, client: Callable | str | None = None, **stage_01_params) -> Result:
    """All stages. A stage that fails ends the flow; only the debug report's failure is a warning."""
    flow = FL.normalize_flow(flow)
    out = Result(success=True, flow=flow)
    where = {n: f"{output_dir}/{folder}/{flow}" for n, folder in FOLDERS.items()}
    try:
        source = S.resolve_input(spark, input_dir, flow)
        params = {
            1: {"in_dir": source, "out_dir": where[1], **stage_01_params}, 2: {"in_dir": where[1], "out_dir": where[2], "engine": engine, "client": client}, 3: {"in_dir": where[2], "out_dir": where[3]},
            4: {"stage01_dir": where[1], "stage02_dir": where[2], "stage03_file": where[3], "out_dir": where[4]}, 5: {"stage02_dir": where[2], "stage03_file": where[3], "out_dir": where[5]},
        }
        for n, name in STAGES.items():
            try:
                got = run_stage(spark, n, {"flow": flow, **params[n]})
            except Exception as e:  # noqa: BLE001  told in the result
                if n != 5:
                    raise
                out.warnings.append(f"stage_05_debug_report_failed: {e}")
                continue
            out.stages_completed.append(name)
            out.output_files[name[:8]] = where[n]
            out.warnings += got["warnings"]
            if n == 1:
                out.metadata = {"documents_processed": got["processed_count"], "ocr_lang": stage_01_params.get("ocr_lang", "eng+por"), "ocr_dpi": stage_01_params.get("ocr_dpi", 300), "stage01_input_dir": source}
    except Exception as e:  # noqa: BLE001  told in the result
        out.success, out.metadata = False, {}
        out.errors.append(str(e))
    out.completed_at = datetime.now().isoformat()
    return out


def run_results(stages: list[tuple[int, DataFrame]]) -> DataFrame:
    """Per run what its stages did, from (number, (run_id, warnings, error)) of each stage that saw the run.

    A run is there if any stage saw it. Stages count up to the first that
    failed or did not see the run; warnings are those of all stages in their
    order; the error is the first one's. A debug report that failed is a warning.
    """
    every = None
    for number, df in stages:
        one = df.select("run_id", F.lit(number).alias("stage"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "error")
        every = one if every is None else every.unionByName(one)
    last = max(STAGES)
    told = F.when((F.col("stage") == last) & F.col("error").isNotNull(), F.array_append("warnings", F.concat(F.lit(f"{STAGES[last]}_failed: "), "error"))).otherwise(F.col("warnings"))
    row = F.struct("stage", told.alias("warnings"), F.when(F.col("stage") != last, F.col("error")).alias("error"), F.col("error").isNull().alias("done"))
    by = every.groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    # The k-th row is stage k as long as none is missing and none before it failed.
    good = F.filter(F.transform("s", lambda x, i: F.when((x["stage"] == i + 1) & (F.size(F.filter(F.slice(F.col("s"), 1, i), lambda y: ~y["done"])) == 0) & x["done"], x["stage"])), lambda n: n.isNotNull())
    names = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    errors = F.slice(F.filter(F.transform("s", lambda x: F.concat(names[x["stage"]], F.lit(": "), x["error"])), lambda e: e.isNotNull()), 1, 1)
    done = by.select("run_id", F.transform(good, lambda n: names[n]).alias("stages_completed"), errors.alias("errors"), F.flatten(F.col("s.warnings")).alias("warnings"))
    # The report is the last stage that a run needs.
    return done.select("run_id", ((F.size("errors") == 0) & (F.size("stages_completed") >= last - 1)).alias("success"), "stages_completed", "errors", "warnings")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tradeloom", description="Trade documents: text, fields, comparisons, reports")
    parser.add_argument("--input", help="folder of PDF files")
    parser.add_argument("--output", help="folder for the files of all stages")
    parser.add_argument("--flow", default="importation", choices=FL.FLOWS)
    parser.add_argument("--stage", help="only this stage, 1 to 5")
    parser.add_argument("--param", action="append", default=[], help="key=value of a single stage")
    parser.add_argument("--read", help="module:function that gives the texts of a PDF's pages")
    parser.add_argument("--ocr", help="module:function that reads a page by OCR")
    parser.add_argument("--engine", choices=sorted(FL.ENGINES), help="rules (regex) or a model (llm) for the fields")
    parser.add_argument("--client", help="module:function that answers a prompt")
    parser.add_argument("--ocr-lang", default="eng+por")
    parser.add_argument("--ocr-dpi", type=int, default=300)
    parser.add_argument("--min-chars", type=int, default=80)
    parser.add_argument("--json", action="store_true", help="print the result as JSON")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tradeloom").getOrCreate()
    if args.stage:
        params = dict(p.partition("=")[::2] for p in args.param)
        if args.engine:
            params |= {"engine": args.engine, "client": args.client}
        if args.read:
            params |= {"read": args.read, "ocr": args.ocr, "min_chars": args.min_chars, "ocr_lang": args.ocr_lang, "ocr_dpi": args.ocr_dpi}
        print(json.dumps(run_stage(spark, args.stage, {"flow": args.flow, **params})))
        return 0
    if not (args.input and args.output):
        parser.error("--input and --output are needed")
    result = run_flow(spark, args.input, args.output, args.flow, engine=args.engine, client=args.client, read=args.read, ocr=args.ocr, min_chars=args.min_chars, ocr_lang=args.ocr_lang, ocr_dpi=args.ocr_dpi)
    if args.json:
        print(json.dumps(asdict(result), indent=2))
    else:
        print("OK" if result.success else "FAILED", *result.stages_completed, sep="\n  ")
        for line in [*result.errors, *result.warnings]:
            print("  -", line)
    return int(not result.success)
