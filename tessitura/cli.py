"""Command line: validate, convert and diff score documents. Exit 0: sound; 1: errors found or a difference; 2: unreadable or not on offer."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import decode
from .plans import validation
from .session import session
from .sources import musicxml, score_json


def _readable(scores: DataFrame) -> bool:
    return not scores.where("_broken is not null or id is null or parts is null").limit(1).count()


def report(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(exit code, report) of one document; a report holds a summary and the ordered issues."""
    scores = score_json.read_scores(spark, path).cache()
    if not _readable(scores):
        return 2, {"error": "no score document"}
    rows = validation.validate(scores).orderBy("score_id", "issue_idx").collect()
    issues = [{"severity": r.severity, "code": r.code, "message": r.message, "node_id": r.node_id, **({"related_node_ids": list(r.related_node_ids)} if r.related_node_ids else {})} for r in rows]
    count = lambda kind: sum(i["severity"] == kind for i in issues)
    return int(count("error") > 0), {"summary": {"total": len(issues), "errors": count("error"), "warnings": count("warning"), "info": count("info")}, "issues": issues}


def convert(spark: SparkSession, path: str, to: str) -> tuple[int, str]:
    scores = score_json.read_scores(spark, path).cache()
    if to not in ("musicxml", "json") or not _readable(scores):
        return 2, f"cannot convert {path} to {to}"
    if to == "json":
        return 0, score_json.to_json(scores).first()["json"]
    row = musicxml.to_musicxml(scores).first()
    return (2, row["error"]) if row["error"] else (0, row["xml"])


def differs(spark: SparkSession, left: str, right: str) -> bool:
    """Whether two documents differ in anything but the order of JSON fields."""
    a, b = (score_json.to_json(score_json.read_scores(spark, p)) for p in (left, right))
    return decode.structural_diff(a, b).limit(1).count() > 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessitura")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("validate").add_argument("path")
    one = commands.add_parser("convert")
    one.add_argument("path")
    one.add_argument("--to", default="musicxml")
    two = commands.add_parser("diff")
    two.add_argument("path")
    two.add_argument("other")
    for name in ("render", "inspect", "recognize"):
        commands.add_parser(name).add_argument("path", nargs="?")
    given = parser.parse_args(arguments)
    if given.command in ("render", "inspect", "recognize"):
        print(f"{given.command} is not on offer", file=sys.stderr)
        return 2
    spark = session("local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
    if given.command == "validate":
        code, body = report(spark, given.path)
        print(json.dumps(body, indent=2))
    elif given.command == "convert":
        code, text = convert(spark, given.path, given.to)
        print(text, file=sys.stderr if code else sys.stdout)
    else:
        code = int(differs(spark, given.path, given.other))
    return code


if __name__ == "__main__":
    sys.exit(main())
