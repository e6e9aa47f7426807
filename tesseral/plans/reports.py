"""Result tables as Markdown, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions import capacity, codec
from ..sources import files

#: Rows that a report may have; reports are of aggregates.
MOST_ROWS = 10_000


def markdown(df: DataFrame, title: str) -> str:
    """A table of at most MOST_ROWS rows, in the order of its first columns."""
    rows = df.orderBy(*df.columns[:2]).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")

    def cell(x: object) -> str:
        return "" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x).replace("|", "\\|")

    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def _payloads(path: Path):
    """The payloads of a container file, or the one that a file is."""
    with open(path, "rb") as data:
        magic = data.read(4)
    return files.container_payloads(path) if magic == codec.CONTAINER_MAGIC else [path.read_bytes()]


def evidence(request: str, found: dict) -> dict[str, bytes]:
    """The five files of an outcome's bundle."""
    told = {k: v for k, v in found.items() if k != "certificate"}
    normalized = capacity.normalize(capacity.parse(request)) if found["digest"] else None
    lines = [f"# {found['outcome']}", "", *(f"* {k}: {v}" for k, v in told.items() if v is not None and k != "outcome")]
    parts = {"request.normalized.json": normalized, "outcome.json": told, "metrics.json": normalized and normalized["resource_limits"]}
    out = {name: (json.dumps(value, indent=2) + "\n").encode() for name, value in parts.items()}
    return out | {"certificate.json": (found["certificate"] or "null").encode(), "report.md": ("\n".join(lines) + "\n").encode()}


def profile_files(report: DataFrame, meta: dict, policy: object) -> dict[str, bytes]:
    """The five files of a profile's bundle: the capture, the groups, their summary, the sampling plan and the totals."""
    from ..operators import profiling

    groups = [r.asDict() for r in report.orderBy("group_id").limit(MOST_ROWS + 1).collect()]
    if len(groups) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} groups")
    plan = {"seed": policy.seed, "max_pairs": policy.max_pairs, "exact_vector_threshold": policy.exact_vector_threshold, "groups": [{"group_id": g["group_id"], "evaluated_pairs": g["evaluated_pairs"], "status": g["status"]} for g in groups]}
    totals = profiling.aggregate(report).first().asDict()
    parts = {"capture-manifest.json": meta, "geometry.json": groups, "sampling-plan.json": plan, "metrics.json": totals}
    summary = markdown(report.select("group_id", "status", "vector_count", "finite_vector_count", "evaluated_pairs", "mean_cosine"), "Geometry")
    return {name: (json.dumps(value, indent=2) + "\n").encode() for name, value in parts.items()} | {"summary.md": summary.encode()}


def main(args: list[str] | None = None) -> int:
    """encode, decode and inspect files; evaluate, bound and check capacity documents; verify bundles. construct and derive-kv are always refused."""
    parser = argparse.ArgumentParser(prog="tesseral")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode"):
        p = commands.add_parser(name)
        p.add_argument("input", type=Path)
        p.add_argument("output", type=Path)
        p.add_argument("--dtype", choices=sorted(codec.WIDTHS), default="f32")
        p.add_argument("--chunk-values", type=int, default=1 << 18)
        p.add_argument("--stride", type=int)
    for name in ("inspect", "evaluate", "bound", "check", "verify", "construct", "derive-kv"):
        commands.add_parser(name).add_argument("input", type=Path)
    commands.choices["evaluate"].add_argument("--bundle", type=Path)
    a = parser.parse_args(args)
    try:
        if a.command == "encode":
            files.encode_file(a.input, a.output, dtype=a.dtype, chunk_values=a.chunk_values, stride=a.stride)
        elif a.command == "decode":
            files.write_atomic(a.output, (codec.decode_exact(p)[0] for p in _payloads(a.input)))
        elif a.command == "inspect":
            for p in _payloads(a.input):
                header, strategy, dtype = codec.describe(p)
                print(json.dumps({"values": header.count, "strategy": strategy, "dtype": dtype, "bytes": len(p)}))
        elif a.command == "evaluate":
            text = a.input.read_text()
            found = capacity.evaluate(text)
            if a.bundle:
                files.write_bundle(a.bundle, evidence(text, found))
            print(json.dumps(found))
            return found["exit_code"]
        elif a.command == "bound":
            found = capacity.evaluate(a.input.read_text())
            print(json.dumps({k: found[k] for k in ("digest", "upper_bound", "reason")}))
            return 0 if found["upper_bound"] else capacity.EXIT[found["outcome"]]
        elif a.command in ("construct", "derive-kv"):
            print(f"{a.command} is refused: finite bounds only rule out, they never construct", file=sys.stderr)
            return capacity.EXIT["REFUSED"]
        elif a.command == "check":
            verdict, why = capacity.check_json(a.input.read_text())
            print(verdict, why)
            return 0 if verdict == "VALID" else 4
        elif wrong := files.verify_bundle(a.input):
            print("\n".join(wrong))
            return 1
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 5
    return 0


if __name__ == "__main__":
    sys.exit(main())
