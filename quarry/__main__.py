"""``python -m quarry report PATH``: the report of a journal as JSON on standard output.
``--lenient`` leaves broken lines and unknown kinds behind instead of failing."""

import argparse

from quarry.operators.report import document
from quarry.session import get_spark
from quarry.sources.journal import checked, read_lines


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    report = commands.add_parser("report")
    report.add_argument("path")
    report.add_argument("--lenient", action="store_true")
    chosen = parser.parse_args(arguments)
    lines = checked(read_lines(get_spark(), chosen.path), strict=not chosen.lenient)
    print(document(lines).first().report)


if __name__ == "__main__":
    main()
