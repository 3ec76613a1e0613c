"""Command line: python -m palimpsest cut|merge|pack|unpack ... Sources are paths or http:// addresses; '-' is standard input.

Results go to standard output, but for the pack file of pack and the dump that unpack makes of a pack file: those are written
beside their sources.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans import dumps
from .sources import dump, sinks


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    modes = top.add_subparsers(dest="mode", required=True)
    for name, many in (("cut", None), ("merge", "+"), ("pack", "+"), ("unpack", None)):
        p = modes.add_parser(name)
        p.add_argument("source", **({"nargs": many} if many else {"nargs": "?", "default": "-"}))
        if name != "unpack":
            p.add_argument("--lastrev", action="store_true")
            p.add_argument("--ns", type=int)
            p.add_argument("--cutmeta", action="store_true")
            p.add_argument("--strict", action="store_true")
        if name == "pack":
            p.add_argument("--zip", default="auto", choices=["auto", "none", "gz", "gzip", "bz2", "bzip2", "lzo", "xz"])
        p.add_argument("--debug", action="store_true", help="the plan on standard error")
        p.add_argument("--cpuprofile", metavar="FOLDER", help="profiles of the Python functions, by time")
        p.add_argument("--memprofile", metavar="FOLDER", help="the same by memory, where the package for it is installed")
        if name == "unpack":
            where = p.add_mutually_exclusive_group()
            where.add_argument("-c", "--stdout", action="store_true", help="standard output, even for a pack file")
            where.add_argument("-f", "--file", action="store_true", help="the named dump, even for standard input")
            p.add_argument("--changedump", action="store_true")
            p.add_argument("--magic", default=None)
            p.add_argument("--address", default=None)
        if name != "pack":
            p.add_argument("--out", help="a file instead of standard output")
    return top


def main(args: list[str] | None = None) -> int:
    a = arguments().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    profile = "perf" if a.cpuprofile else "memory" if a.memprofile else None
    if profile:
        spark.conf.set("spark.sql.pyspark.udf.profiler", profile)
    how = {k: getattr(a, k) for k in ("lastrev", "ns", "cutmeta", "strict") if hasattr(a, k)}
    given = [a.source] if isinstance(a.source, str) else a.source
    paths = [dump.spool(spark) if s == "-" else dump.fetch(spark, [s])[0] if s.startswith("http://") else s for s in given]
    if a.mode == "pack":
        print(dumps.pack_dump(spark, paths, compression=a.zip, debug=a.debug, **how))
    else:
        out = a.out
        if a.mode == "unpack":
            lines = {k: v for k in ("magic", "address") if (v := getattr(a, k))}
            rows, named = dumps.unpack_dump(spark, paths[0], a.changedump, folder=os.getcwd() if given == ["-"] else None, **lines)
            # as the pack's name says, unless it came through standard input
            out = out or (named if a.file or (given != ["-"] and not a.stdout) else None)
        elif a.mode == "merge":
            rows = dumps.merge_dumps(spark, paths, **how)
        else:
            rows = dumps.cut_dump(spark, paths[0], **how)
        if a.debug:
            dumps.explained(rows)
        sinks.write_dump(rows, out) if out else sinks.stream_dump(rows)
    if profile:
        spark.profile.dump(a.cpuprofile or a.memprofile)
    return 0


if __name__ == "__main__":
    sys.exit(main())
