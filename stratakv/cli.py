"""Commands: ``dump FILE [--all]`` and ``compact [--for-ingest] [--list LIST] OUT [IN ...]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .plans.compaction import compact_files, dump, read_sst
from .sources.codec.errors import SstError

SHOWN = 20


def run_dump(spark: SparkSession, path: str, everything: bool) -> list[str]:
    """The lines to print: each entry, or a summary with the first entries."""
    entries = read_sst(spark, path)
    if everything:
        return [r.line for r in dump(entries).toLocalIterator()]
    out = [f"{f.file_path}: magic {f.magic}, format version {f.format_version}, checksum {f.checksum_type}" for f in read_sst(spark, path, view="files").collect()]
    total = entries.count()
    out += [f"  {r.line}" for r in dump(entries.limit(SHOWN)).collect()]
    if total > SHOWN:
        out.append(f"  ... ({total - SHOWN} more)")
    return [*out, f"{total} entries"]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratakv", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("dump", help="show a table file")
    one.add_argument("path")
    one.add_argument("--all", action="store_true", help="print every entry as key ==> value")
    two = commands.add_parser("compact", help="compact table files into one folder")
    two.add_argument("--for-ingest", action="store_true")
    two.add_argument("--files", type=int, help="as many at most; else files follow the bytes")
    two.add_argument("--list", help="a text file that names one input a line")
    two.add_argument("output")
    two.add_argument("inputs", nargs="*")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("stratakv").getOrCreate()
    try:
        if given.command == "dump":
            print("\n".join(run_dump(spark, given.path, given.all)))
            return 0
        inputs = list(given.inputs)
        if given.list:
            with open(given.list) as f:
                inputs += [line.strip() for line in f if line.strip()]
        if not inputs:
            raise SstError("no input files")
        compact_files(spark, inputs, given.output, given.for_ingest, files=given.files)
        return 0
    except (SstError, OSError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
