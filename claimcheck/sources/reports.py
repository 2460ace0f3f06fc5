"""Report documents: read, validate, flatten, nest again, and write judged ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimcheck.functions.text import let
from claimcheck.plans.verify import VERDICTS

# Findings, issues and caveats per written document, unless the caller says otherwise. A longer
# report continues in further parts, each with the whole header and its own place in the report.
PART_SIZE = 10_000


def read_reports(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """JSON documents, one per file or one per line: report_id, doc VARIANT.

    The parts of a long report get the one report_id they carry. Equal lines are reports of
    their own, told apart by a number.
    """
    text = spark.read.text(path, wholetext=not one_per_line)
    if one_per_line:
        counted = text.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy")
        own_id, text = F.sha2("value", 256), counted.select("value", copy)
        number = F.when(F.col("copy") > 1, F.concat(F.lit("#"), F.col("copy").cast("string"))).otherwise("")
    else:
        own_id, number = F.col("_metadata.file_path"), F.lit("")
    text = _with_doc(text.select("value", own_id.alias("own_id"), number.alias("number")), "value")
    carried = F.try_variant_get("doc", "$.part.report_id", "string")
    return text.select(F.concat(F.coalesce(carried, "own_id"), "number").alias("report_id"), "doc")


def _part_number(doc: Column) -> Column:
    return F.coalesce(F.try_variant_get(doc, "$.part.number", "bigint"), F.lit(0).cast("bigint"))


def _first_pos(doc: Column) -> Column:
    """Position in the whole report of a part's first finding and first note."""
    return _part_number(doc) * F.coalesce(F.try_variant_get(doc, "$.part.size", "bigint"), F.lit(0).cast("bigint"))


def incomplete_reports(reports: DataFrame) -> DataFrame:
    """Reports some of whose parts are not there: report_id, parts, found."""
    parts = F.coalesce(F.try_variant_get("doc", "$.part.of", "bigint"), F.lit(1).cast("bigint"))
    found = reports.groupBy("report_id").agg(
        F.max(parts).alias("parts"), F.count_distinct(_part_number(F.col("doc"))).alias("found")
    )
    return found.where("found < parts")


def parse_reports(reports: DataFrame, column: str = "json") -> DataFrame:
    """Documents held in a text column, as doc VARIANT.

    Documents are small in bytes and heavy to check: those of one file are dealt out to all tasks, by
    report_id and text.
    """
    conf = reports.sparkSession.conf
    keys = [c for c in ("report_id", column) if c in reports.columns]
    dealt = reports.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys)
    return _with_doc(dealt, column).drop(column)


def _with_doc(texts: DataFrame, column: str) -> DataFrame:
    """Every text parsed once. A filter on a plain column would move below and parse at each mention of it."""
    return texts.select("*", F.explode(F.array(F.try_parse_json(column))).alias("doc"))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID; '' when missing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1), F.lit(""))


def _items(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _is_text(value: Column, path: str) -> Column:
    return (_kind(_at(value, path)) == "STRING") & (F.try_variant_get(value, path, "string") != "")


def _is_text_list(value: Column, path: str) -> Column:
    return (_kind(_at(value, path)) == "ARRAY") & F.coalesce(
        F.forall(_items(value, path), lambda item: _kind(item) == "STRING"), F.lit(False)
    )


_NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]


def _unless(ok: Column, problem: str | Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), problem)


def _finding_problems(finding: Column, i: Column) -> Column:
    name = F.concat(F.lit("findings["), i.cast("string"), F.lit("]"))

    def say(text: str) -> Column:
        return F.concat(name, F.lit(text))

    fields = F.array(
        _unless(_is_text(finding, "$.claim"), say(".claim must be a non-empty string")),
        _unless(
            _is_text(finding, "$.evidence_sql_or_code"),
            say(".evidence_sql_or_code must be a non-empty string"),
        ),
        _unless(
            _kind(_at(finding, "$.value")).isin("STRING", *_NUMBERS), say(".value must be a string or number")
        ),
    )
    return F.when(_kind(finding) == "OBJECT", fields).otherwise(F.array(say(" must be an object")))


def report_problems(doc: Column) -> Column:
    """Everything wrong with a report document, in a fixed order; an empty array when it is valid."""
    # Unrolled into the code of its stage, the check is a method too long to be compiled to machine code.
    return let(doc, _problems)


def _problems(doc: Column) -> Column:
    dataset = F.array(
        _unless(_is_text(doc, "$.dataset.name"), "'dataset.name' must be a non-empty string"),
        _unless(_kind(_at(doc, "$.dataset.rows")) == "BIGINT", "'dataset.rows' must be an integer"),
        _unless(_kind(_at(doc, "$.dataset.cols")) == "BIGINT", "'dataset.cols' must be an integer"),
    )
    baseline = F.array(
        _unless(_is_text(doc, "$.baseline.model"), "'baseline.model' must be a non-empty string"),
        _unless(_is_text_list(doc, "$.baseline.features"), "'baseline.features' must be a list of strings"),
        _unless(_is_text(doc, "$.baseline.metric_name"), "'baseline.metric_name' must be a non-empty string"),
        _unless(
            _kind(_at(doc, "$.baseline.metric_value")).isin(_NUMBERS), "'baseline.metric_value' must be numeric"
        ),
    )
    findings = let(
        _items(doc, "$.findings"),
        # A part may hold nothing but notes.
        lambda items: F.when(
            (F.size(items) == 0) & (_kind(_at(doc, "$.part")) != "OBJECT"),
            F.array(F.lit("'findings' must not be empty")),
        ).otherwise(F.flatten(F.transform(items, _finding_problems))),
    )

    def one(problem: str) -> Column:
        return F.array(F.lit(problem))

    issues = _is_text_list(doc, "$.data_quality_issues")
    caveats = (_kind(_at(doc, "$.caveats")) == "") | _is_text_list(doc, "$.caveats")
    found = F.concat(
        F.when(_kind(_at(doc, "$.dataset")) == "OBJECT", dataset).otherwise(
            one("'dataset' must be an object with name, rows, cols")
        ),
        F.when(_kind(_at(doc, "$.findings")) == "ARRAY", findings).otherwise(one("'findings' must be a list")),
        F.array(_unless(issues, "'data_quality_issues' must be a list of strings")),
        F.when(_kind(_at(doc, "$.baseline")) == "OBJECT", baseline).otherwise(
            one("'baseline' must be an object with model, features, metric_name, metric_value")
        ),
        F.array(_unless(caveats, "'caveats' must be a list of strings")),
    )
    return F.when(_kind(doc) == "OBJECT", F.array_compact(found)).otherwise(
        one("report must be a JSON object")
    )


def valid_reports(reports: DataFrame) -> DataFrame:
    return reports.where(F.size(report_problems(F.col("doc"))) == 0)


def report_datasets(reports: DataFrame) -> DataFrame:
    return reports.where(_part_number(F.col("doc")) == 0).select(
        "report_id",
        F.variant_get("doc", "$.dataset.name", "string").alias("name"),
        F.variant_get("doc", "$.dataset.rows", "bigint").alias("rows"),
        F.variant_get("doc", "$.dataset.cols", "int").alias("cols"),
    )


def report_findings(reports: DataFrame) -> DataFrame:
    """One row per finding, ready to be judged; keys beyond the three known ones are ignored."""
    finding = F.col("finding")
    value = _at(finding, "$.value")
    is_text = _kind(value) == "STRING"
    placed = reports.select(
        "report_id",
        _first_pos(F.col("doc")).alias("first"),
        F.posexplode(_items(F.col("doc"), "$.findings")).alias("pos", "finding"),
    )
    return placed.withColumn("finding_pos", (F.col("first") + F.col("pos")).cast("int")).select(
        F.concat_ws("#", "report_id", "finding_pos").alias("finding_id"),
        "report_id",
        "finding_pos",
        F.variant_get(finding, "$.claim", "string").alias("claim"),
        F.variant_get(finding, "$.evidence_sql_or_code", "string").alias("evidence"),
        F.when(is_text, "string").otherwise("number").alias("value_kind"),
        F.when(~is_text, F.try_variant_get(finding, "$.value", "double")).alias("value_num"),
        F.variant_get(finding, "$.value", "string").alias("value_text"),
    )


def report_baselines(reports: DataFrame) -> DataFrame:
    return reports.where(_part_number(F.col("doc")) == 0).select(
        "report_id",
        F.variant_get("doc", "$.baseline.model", "string").alias("model"),
        F.variant_get("doc", "$.baseline.features", "array<string>").alias("features"),
        F.variant_get("doc", "$.baseline.metric_name", "string").alias("metric_name"),
        F.variant_get("doc", "$.baseline.metric_value", "double").alias("metric_value"),
        F.coalesce(F.try_variant_get("doc", "$.baseline.notes", "string"), F.lit("")).alias("notes"),
    )


def report_notes(reports: DataFrame) -> DataFrame:
    """Data-quality issues and caveats: report_id, kind, pos, text."""

    def notes(path: str, kind: str) -> DataFrame:
        items = F.try_variant_get("doc", path, "array<string>")
        placed = reports.select(
            "report_id", _first_pos(F.col("doc")).alias("first"), F.posexplode(items).alias("i", "text")
        )
        pos = (F.col("first") + F.col("i")).cast("int").alias("pos")
        return placed.select("report_id", F.lit(kind).alias("kind"), pos, "text")

    return notes("$.data_quality_issues", "issue").unionByName(notes("$.caveats", "caveat"))


def json_value(kind: Column, text: Column) -> Column:
    """A claimed or recomputed value as VARIANT: a number stays a number."""
    return F.when(kind == "number", F.try_parse_json(text)).otherwise(text.cast("variant"))


def _ordered(pos: str, item: Column, when: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(when, F.struct(F.col(pos).alias("pos"), item.alias("item")))))


def _place(pos: Column, part_size: int) -> Column:
    return F.floor(pos / part_size).cast("bigint")


def _headers(*tables: DataFrame) -> DataFrame:
    """An item without content per report, so that a report without findings and notes is written too."""
    nothing = [F.lit(None).cast("string").alias("kind"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("json")]
    return reduce(DataFrame.unionByName, [t.select("report_id", *nothing) for t in tables])


def _parts(items: DataFrame, part_size: int) -> DataFrame:
    """Collect (report_id, kind, pos, json) into JSON arrays, `part_size` positions at a time."""

    def array(kind: str) -> Column:
        texts = F.transform(_ordered("pos", F.col("json"), F.col("kind") == kind), lambda x: x["item"])
        return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))

    return items.groupBy("report_id", _place(F.col("pos"), part_size).alias("part")).agg(
        array("finding").alias("findings"), array("issue").alias("issues"), array("caveat").alias("caveats")
    )


def _part_key(part_size: int) -> Column:
    """Which part of which report a document is; NULL when it is the whole report."""
    place = F.struct(
        "report_id", F.col("part").alias("number"), F.col("parts").alias("of"), F.lit(part_size).alias("size")
    )
    return F.when(F.col("parts") > 1, F.to_json(place))


def _json_text(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def _document(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object out of JSON texts; a NULL text leaves its key out."""
    pairs = [F.concat(F.lit(f'"{name}":'), text) for name, text in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def _notes_items(notes: DataFrame) -> DataFrame:
    return notes.select("report_id", "kind", "pos", _json_text(F.col("text")).alias("json"))


def nest_reports(
    datasets: DataFrame, findings: DataFrame, baselines: DataFrame, notes: DataFrame, part_size: int = PART_SIZE
) -> DataFrame:
    """Report documents out of their tables: report_id, part, json.

    A report with more than `part_size` findings, issues or caveats continues in further
    documents; reading them back joins them by the report_id and the place that each carries.
    """
    finding = F.to_json(
        F.struct(
            "claim",
            F.col("evidence").alias("evidence_sql_or_code"),
            json_value(F.col("value_kind"), F.col("value_text")).alias("value"),
        )
    )
    items = (
        findings.select(
            "report_id", F.lit("finding").alias("kind"), F.col("finding_pos").alias("pos"), finding.alias("json")
        )
        .unionByName(_notes_items(notes))
        .unionByName(_headers(datasets, baselines))
    )
    parts = items.groupBy("report_id").agg((_place(F.max("pos"), part_size) + 1).alias("parts"))
    dataset = datasets.select("report_id", F.to_json(F.struct("name", "rows", "cols")).alias("dataset"))
    baseline = baselines.select(
        "report_id",
        F.to_json(F.struct("model", "features", "metric_name", "metric_value", "notes")).alias("baseline"),
    )
    document = _document(
        [
            ("part", _part_key(part_size)),
            ("dataset", F.col("dataset")),
            ("findings", F.col("findings")),
            ("data_quality_issues", F.col("issues")),
            ("baseline", F.col("baseline")),
            ("caveats", F.col("caveats")),
        ]
    )
    return (
        _parts(items, part_size)
        .join(parts, "report_id")
        .join(dataset, "report_id", "left")
        .join(baseline, "report_id", "left")
        .select("report_id", "part", document.alias("json"))
    )


def judged_reports(
    judged: DataFrame,
    datasets: DataFrame | None = None,
    judged_baselines: DataFrame | None = None,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """Judged report documents: report_id, part, json. Every part carries the header and the whole summary."""
    finding = F.to_json(
        F.struct(
            "claim",
            F.col("evidence").alias("evidence_sql_or_code"),
            json_value(F.col("value_kind"), F.col("value_text")).alias("claimed_value"),
            "verdict",
            json_value(F.col("value_kind"), F.col("recomputed_text")).alias("recomputed_value"),
            "detail",
            "evidence_row_count",
            "provenance_note",
        ),
        {"ignoreNullFields": "false"},
    )
    items = judged.select(
        "report_id", F.lit("finding").alias("kind"), F.col("finding_pos").alias("pos"), finding.alias("json")
    )
    others = [t for t in (datasets, judged_baselines) if t is not None]
    if others:
        items = items.unionByName(_headers(*others))
    outcomes = judged.select("report_id", F.col("finding_pos").cast("bigint").alias("pos"), "verdict")
    at_start = F.lit(0).cast("bigint").alias("pos")
    if datasets is not None:
        outcomes = outcomes.unionByName(
            datasets.select("report_id", at_start, F.lit(None).cast("string").alias("verdict"))
        )
    if judged_baselines is not None:
        outcomes = outcomes.unionByName(judged_baselines.select("report_id", at_start, "verdict"))
    whole = outcomes.groupBy("report_id").agg(
        (_place(F.max("pos"), part_size) + 1).alias("parts"),
        F.to_json(F.struct(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])).alias("summary"),
    )
    documents = _parts(items, part_size).join(whole, "report_id")
    dataset_json = baseline_json = F.lit(None).cast("string")
    if datasets is not None:
        dataset = datasets.select("report_id", F.to_json(F.struct("name", "rows", "cols")).alias("dataset"))
        documents, dataset_json = documents.join(dataset, "report_id", "left"), F.col("dataset")
    if judged_baselines is not None:
        fields = ["model", "features", "metric_name", F.col("metric_value").alias("claimed_value"),
                  "verdict", "recomputed_value", "detail"]
        baseline = judged_baselines.select(
            "report_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("baseline")
        )
        documents, baseline_json = documents.join(baseline, "report_id", "left"), F.col("baseline")
    document = _document(
        [
            ("part", _part_key(part_size)),
            ("dataset", dataset_json),
            ("findings", F.col("findings")),
            ("baseline", baseline_json),
            ("summary", F.col("summary")),
        ]
    )
    return documents.select("report_id", "part", document.alias("json"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.select("json").write.mode("overwrite").text(path)
