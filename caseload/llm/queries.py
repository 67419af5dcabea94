"""The registered query of every operator and the pipeline, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from caseload.llm import (
    alignment, decontam, fingerprint, hmm, langid, license_scan, merkle, mixing, packing, pii, sharding, simhash, toxicity)
from caseload.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(report: Callable[..., DataFrame], *others: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(*(table(spark, sf_dir, name) for name in ("documents", *others)))

    return run


QUERIES: dict[str, Query] = {
    "op1_license_scan": _on_documents(license_scan.scan),
    "op2_simhash": _on_documents(simhash.report),
    "op3_mixing": _on_documents(mixing.report),
    "op4_decontamination": _on_documents(decontam.report, "benchmark"),
    "op5_language": _on_documents(langid.report),
    "op6_personal_data": _on_documents(pii.report),
    "op7_sharding": _on_documents(sharding.report),
    "op8_language_model": _on_documents(hmm.report),
    "op9_fingerprint": _on_documents(fingerprint.report),
    "op10_toxicity": _on_documents(toxicity.report, "labels"),
    "op11_best_fit_packing": _on_documents(packing.report),
    "op12_tokenizer_alignment": _on_documents(alignment.report),
    "op13_merkle_manifest": _on_documents(merkle.report),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.SQL, "op4_decontamination": decontam.SQL, "op13_merkle_manifest": merkle.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
