"""Whole reports: documents in, every finding and the baseline checked, judged documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimcheck.operators.baseline import Recipe, verify_baselines
from claimcheck.plans.verify import judge_findings
from claimcheck.session import adopt, materialize
from claimcheck.sources import reports as documents


def verify_reports(
    spark: SparkSession,
    reports: DataFrame,
    dataset: DataFrame,
    recipe: Recipe,
    dataset_path: str | None = None,
    run_logs: DataFrame | None = None,
    part_size: int = documents.PART_SIZE,
) -> DataFrame:
    """Judged documents of all valid reports (report_id, doc) about `dataset`: report_id, part, json.

    `recipe` says how the dataset becomes the training table of a baseline. Reports that are
    not valid have no judged document; `report_problems` says why. Judged findings and baselines
    are written once, as both the documents and their summaries read them.
    """
    valid = materialize(documents.valid_reports(reports), "valid-reports")
    judged = judge_findings(spark, documents.report_findings(valid), dataset, dataset_path, run_logs)
    baselines = verify_baselines(documents.report_baselines(valid), dataset, recipe)
    return documents.judged_reports(
        adopt(spark, materialize(judged, "judged")),
        documents.report_datasets(valid),
        materialize(baselines, "judged-baselines"),
        part_size,
    )
