"""Benchmark reports as Markdown and JSON, from frames of a row a variant or a failed case."""

from __future__ import annotations

import difflib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import score
from . import benchmark


def percent(x: float | None) -> str:
    return "—" if x is None else f"{x:.1%}"


def name(label: str) -> str:
    return "`" + label.replace("|", "\\|") + "`"


def grid(heads: list[str], rows: list[list[str]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(heads), "|---" + "|---:" * (len(heads) - 1) + "|", *map(line, rows)]


def leaderboard_lines(ranked: list) -> list[str]:
    heads = ["Model", "Score", "Cases passed", "Fidelity failures", "Recall", "Precision", "Exactness", "Determinism", "Mean s/case"]
    rows = [
        [name(r["label"]), f"{r['score']:.3f}", f"{r['passed']}/{r['cases']}", str(r["fidelity_failures"]), percent(r["recall"]), percent(r["precision"]), percent(r["exactness"]), percent(r["determinism"]), f"{r['mean_seconds']:.2f}"]
        for r in ranked
    ]
    return grid(heads, rows)


def matrix_lines(title: str, ranked: list, cells: list, column: str) -> list[str]:
    """Mean score and passes for each model and label."""
    labels = sorted({c[column] for c in cells})
    by = {(c["label"], c[column]): f"{c['score']:.2f} ({c['passed']}/{c['cases']})" for c in cells}
    return ["", f"## {title}", "", *grid(["Model", *labels], [[name(r["label"]), *(by.get((r["label"], x), "—") for x in labels)] for r in ranked])] if labels else []


def protocol_lines(ranked: list) -> list[str]:
    fields = ("proposed_edits", "applied_edits", "unanchored", "ambiguous", "oversized", "label_only")
    rows = [[name(r["label"]), *(str(r[f]) for f in fields), percent(r["anchor_failure_rate"])] for r in ranked]
    return ["", "## Contract", "", *grid(["Model", "Proposed", "Applied", "Unanchorable", "Ambiguous", "Oversized", "Label-only", "Anchor failure rate"], rows)]


def trap_lines(traps: list) -> list[str]:
    return ["", "## Traps", "", *grid(["Model", "Trap", "Runs"], [[name(t["label"]), t["trap"], str(t["failures"])] for t in traps])] if traps else []


def appendix_lines(failed: list) -> list[str]:
    out = ["", "## Failures"] if failed else []
    for label in dict.fromkeys(f["label"] for f in failed):
        own = [f for f in failed if f["label"] == label]
        for f in own:
            diff = difflib.unified_diff([f["gold"]], [f["prepared_text"]], "gold", "output", lineterm="")
            out += ["", f"### {name(label)}: {f['case_id']} ({f['score']:.2f})", "", "```diff", *diff, "```"]
        if own[0]["more"]:
            out += ["", f"{own[0]['more']} more."]
    return out


def with_seconds(runs: DataFrame) -> DataFrame:
    return runs if "seconds" in runs.columns else runs.withColumn("seconds", F.lit(0.0))


def report(runs: DataFrame, most_failures: int = 5) -> tuple[str, str]:
    """(Markdown, JSON) of scored runs. Only aggregates and the few worst failures reach the driver."""
    runs = with_seconds(runs)
    mean = runs.groupBy("label").agg(F.avg("seconds").alias("mean_seconds"))
    ranked = benchmark.leaderboard(runs).join(mean, "label").orderBy("rank").collect()
    tiers = score.summary(runs, "label", "tier").collect()
    categories = score.by_category(runs, "label").collect()
    hits = score.trap_failures(runs.select(F.col("label").alias("variant"), "run", "trap_labels"), "variant")
    hits = hits.withColumnsRenamed({"label": "trap", "variant": "label"})
    traps = hits.orderBy("label", F.desc("failures"), "first_run").collect()
    failed = score.failures(runs, "label", most_failures).select("label", "case_id", "score", "gold", "prepared_text", "more", "place").orderBy("label", "place").collect()
    parts = (
        ["# Benchmark", ""], leaderboard_lines(ranked), matrix_lines("By tier", ranked, tiers, "tier"), matrix_lines("By category", ranked, categories, "category"),
        protocol_lines(ranked), trap_lines(traps), appendix_lines(failed),
    )
    rows = lambda x: [r.asDict(recursive=True) for r in x]
    body = {"schema_version": 2, "models": rows(ranked), "tiers": rows(tiers), "categories": rows(categories), "traps": rows(traps), "failures": rows(failed)}
    return "\n".join(reduce(list.__add__, parts)) + "\n", json.dumps(body, ensure_ascii=False, indent=2)


def summary_line(r) -> str:
    return f"{r['rank']}. {r['label']}: {r['score']:.3f}, {r['passed']}/{r['cases']} passed, {r['fidelity_failures']} fidelity failures"
