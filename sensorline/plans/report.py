"""Findings and the Markdown report of a session."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

FINDING = "check string, verdict string, subject string, detail string"


def findings(spark: SparkSession, rows: Iterable[tuple[str, str, str, dict]]) -> DataFrame:
    """(check, verdict, subject, detail) results as a table."""
    return spark.createDataFrame([(c, v, s, json.dumps(d, sort_keys=True, default=str)) for c, v, s, d in rows], FINDING)


def markdown_table(frame: DataFrame, most: int = 50) -> str:
    """The first rows of a small result as a Markdown table."""
    rows = frame.limit(most).collect()
    show = lambda x: f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", r"\|")
    lines = ["| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def report(title: str, sections: dict[str, DataFrame | str], found: DataFrame | None = None) -> str:
    """A Markdown report: the count of verdicts first, then each section; results are limited to what a page can show."""
    out = [f"# {title}", ""]
    if found is not None:
        out += [markdown_table(found.groupBy("verdict").count().orderBy("verdict")), "", markdown_table(found.orderBy("verdict", "check", "subject")), ""]
    for name, body in sections.items():
        out += [f"## {name}", "", body if isinstance(body, str) else markdown_table(body), ""]
    return "\n".join(out)


def capability_matrix(capabilities: dict[str, bool]) -> list[dict]:
    """Each capability with whether the dataset has it and what follows if not."""
    needs = {
        "has_clock": "no rate, gap or drift check", "multi_stream": "no residuals between streams", "has_imu": "no gravity or bias check", "has_actions": "no action diagnostics and no segments by motion",
        "has_pose": "no quaternion check", "has_force": "no force check", "has_video": "no pairing with frames",
    }
    return [{"capability": c, "present": bool(v), "note": "" if v else needs.get(c, "")} for c, v in sorted(capabilities.items())]


def fit_result(result: dict, most_chars: int = 20_000) -> dict:
    """A result small enough to show: long lists are cut to 50, 20, 10, 5, 2 or 1 items and their full lengths kept; at last
    only plain values stay."""
    def size(x: object) -> int:
        return len(json.dumps(x, default=str))

    def cut(x: object, n: int) -> object:
        if isinstance(x, dict):
            lengths = {f"{k}_total": len(v) for k, v in x.items() if isinstance(v, list) and len(v) > n}
            return {k: cut(v, n) for k, v in x.items()} | lengths
        return [cut(v, n) for v in x[:n]] if isinstance(x, list) else x

    if size(result) <= most_chars:
        return result
    for n in (50, 20, 10, 5, 2, 1):
        if size(smaller := cut(result, n)) <= most_chars:
            return smaller | {"shortened": True}
    return {k: v for k, v in result.items() if isinstance(v, bool | int | float | None) or (isinstance(v, str) and len(v) < 500)} | {"shortened": True}
