"""A whole audit of a repository: files to facts to findings to scorecard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import ci, python_facts, repository
from . import claims, detectors, facts, scorecard


@dataclass(frozen=True)
class Audit:
    files: DataFrame
    facts: DataFrame
    imports: DataFrame
    findings: DataFrame
    junk: DataFrame
    folders: DataFrame


def audit(spark: SparkSession, root: str, ignore: list[str] = (), verdicts: DataFrame | None = None, known: dict[str, str] = {}) -> Audit:  # noqa: B006
    """Proposes findings by all detectors, applies outside verdicts if there are any, and measures the result."""
    found = repository.files(spark, root, list(ignore)).cache()
    parsed = python_facts.python_facts(found).cache()
    imports = facts.resolved_imports(parsed, found).cache()
    text = found.where("NOT is_binary")
    rows = claims.findings(
        {
            "dead_symbol": detectors.dead_symbols(text, parsed, imports),
            "dead_parameter": detectors.dead_parameters(text, parsed, imports),
            "orphan_file": detectors.orphans(parsed, imports, detectors.entry_points(found)),
            "dead_dependency": detectors.dead_dependencies(text, repository.dependencies(found), known),
            "dead_ci_element": detectors.dead_ci_elements(found, ci.ci_elements(text)),
            "contract_violation": detectors.contract_violations(parsed),
            "implicit_contract": detectors.implicit_contracts(parsed, imports),
            "personal_path": detectors.personal_paths(text),
        }
    )
    if verdicts is not None:
        empty = rows.sparkSession.createDataFrame([], "id string, payload string")
        rows = claims.overlay(claims.decided(claims.claims(rows, {"none": empty}, {}, {"none": []}), verdicts))
    return Audit(found, parsed, imports, claims.unified_order(rows), scorecard.junk(rows, text), scorecard.folder_hashes(found))
