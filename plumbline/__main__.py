"""python -m plumbline clean FILE --plan PLAN [--out DIR] | transforms"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description="Clean tables by a plan.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("clean", help="apply a plan to a file")
    one.add_argument("file")
    one.add_argument("--plan", required=True)
    one.add_argument("--out", default="out")
    commands.add_parser("transforms", help="list the transforms")
    args = parser.parse_args(argv)

    from plumbline.operators.transforms import list_transforms

    if args.command == "transforms":
        print(*list_transforms(), sep="\n")
        return 0
    if "://" not in args.file and not Path(args.file).exists():
        print(f"No such file: {args.file}", file=sys.stderr)
        return 2
    from plumbline.plans.plan import run_plan
    from plumbline.session import build
    from plumbline.sources.export import write_artefacts
    from plumbline.sources.router import read_table

    spark = build("plumbline-clean")
    run = run_plan(read_table(spark, args.file), args.plan)
    paths = write_artefacts(run, args.out, Path(args.file).stem)
    for r in run.counts().collect():
        print(f"{r['target_field']}: {r['changed']} changed, {r['flagged']} flagged of {r['rows']}")
    print(*paths.values(), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
