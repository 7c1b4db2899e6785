"""Build an index from references: ``python -m vicinal.sources.build --in references.json.gz --out index``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vicinal.sources.store import build_index


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--in", dest="source", required=True, help="references as a JSON array, or as lines with --lines; may be gzipped")
    p.add_argument("--out", required=True, help="the folder of the index")
    p.add_argument("--lines", action="store_true")
    p.add_argument("--tree", action="store_true", help="leaves of a tree of boxes instead of references by key")
    p.add_argument("--range-bytes", type=int, help="deal an array's byte ranges of this size to tasks; the path is then a URI")
    a = p.parse_args(args)
    n = build_index(SparkSession.builder.getOrCreate(), a.source, a.out, a.lines, "tree" if a.tree else "knn", a.range_bytes)
    print(f"{n} references in {a.out}")
    return n


if __name__ == "__main__":
    main()
