"""Command line: run registered queries and write their results or reports.

    spark-submit marketloom/cli.py list
    spark-submit marketloom/cli.py run NAME --input DIR --output PATH [--format parquet|csv|json]
    spark-submit marketloom/cli.py report NAME --input DIR --output FILE.md
"""

from __future__ import annotations

import argparse
import sys

from marketloom.operators import reports
from marketloom.plans import documents_and_files, imports_and_symbols, news_and_quality, registry  # noqa: F401
from marketloom.session import session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("action", choices=("list", "run", "report"))
    p.add_argument("name", nargs="?")
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--format", default="parquet")
    a = p.parse_args(args)
    if a.action == "list":
        print("\n".join(registry.QUERIES))
        return 0
    if a.name not in registry.QUERIES or not a.input or not a.output:
        print("a known query, --input and --output are needed", file=sys.stderr)
        return 2
    df = registry.QUERIES[a.name](session(), a.input)
    if a.action == "run":
        df.write.mode("overwrite").format(a.format).save(a.output)
    else:
        reports.markdown(a.output, a.name, {"input": a.input}, {"Result": (df, df.columns[:2])})
    return 0


if __name__ == "__main__":
    sys.exit(main())
