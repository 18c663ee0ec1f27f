"""python -m copse DOCUMENT.xml QUERY [FOLDER]: loads a document, runs a query file over it and prints its witness trees.

QUERY is a complex query, whose patterns lie in FOLDER (its own folder by default), or a single pattern file.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from copse.catalog import io_counters
from copse.operators.witness import width
from copse.plans import render
from copse.plans.pattern import parse_pattern
from copse.plans.query import Query, execute, parse_query
from copse.sources.xml import read_xml

SHOWN = 50


def run(spark: SparkSession, document: str, query: str, folder: str | None = None) -> str:
    text = Path(query).read_text()
    asked = parse_query(text, folder or Path(query).parent) if "ptree_1" in text else Query(parse_pattern(text))
    nodes = read_xml(spark, document).persist()
    found = execute(nodes, asked)
    out = [render.show(found, SHOWN), f"{found.count()} records returned by {asked.operation}" + (f", {width(found)} nodes each" if width(found) else "")]
    out += [f"{k}: {v} bytes" for k, v in io_counters(spark).items()]
    nodes.unpersist()
    return "\n".join(out)


if __name__ == "__main__":
    if len(sys.argv) not in (3, 4):
        sys.exit(__doc__)
    session = SparkSession.builder.appName("copse").getOrCreate()
    print(run(session, *sys.argv[1:]))
    session.stop()
