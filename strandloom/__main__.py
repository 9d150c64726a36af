"""python -m strandloom --contigs C --longreads L --samlist S --prefix P [parameters]"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from .config import ScaffoldConfig
from .plans.pipeline import run

OPTIONS = ("mcs", "mcr", "rcn", "rct", "lme", "mit", "nlm", "mlp", "k", "w", "f")


def main() -> None:
    p = argparse.ArgumentParser(prog="strandloom")
    for name in ("contigs", "longreads", "samlist", "prefix"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--ccoverage")
    types = {f.name: f.default for f in fields(ScaffoldConfig)}
    for name in OPTIONS:
        p.add_argument(f"--{name}", type=type(types[name]), default=types[name])
    a = p.parse_args()
    config = ScaffoldConfig(**{n: getattr(a, n) for n in OPTIONS})
    run(SparkSession.builder.appName("strandloom").getOrCreate(), a.contigs, a.longreads, a.samlist, a.prefix, a.ccoverage, config)


if __name__ == "__main__":
    main()
