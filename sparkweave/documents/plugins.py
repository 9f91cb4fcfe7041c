"""Parsers of files as Python callables, by extension.

A handler is (path, bytes) -> facts: dicts with `node` (key, label, props) or `edge` (src, dst, type). Files are dealt to
handlers by extension; what no handler claims goes to the plain reader. Handlers run on the executors, a file at a time;
one that raises yields an error row and not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crawl import route

FACTS = "path string, handler string, kind string, key string, label string, props map<string,string>, src string, dst string, type string, error string"


@dataclass(frozen=True)
class Handler:
    name: str
    extensions: tuple[str, ...]
    parse: Callable[[str, bytes], Iterable[dict]]


def claims(handlers: Iterable[Handler]) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """Handler of each extension (the first that claims it), and the collisions (extension, kept, refused)."""
    by: dict[str, str] = {}
    clashes = []
    for h in handlers:
        for ext in h.extensions:
            ext = ext.lower().lstrip(".")
            if ext in by:
                clashes.append((ext, by[ext], h.name))
            else:
                by[ext] = h.name
    return by, clashes


def parse_files(files: DataFrame, handlers: list[Handler]) -> DataFrame:
    """Facts of files (path, content) that a handler claims."""
    by, _ = claims(handlers)
    parse = {h.name: h.parse for h in handlers}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, handler in zip(pdf["path"], pdf["content"], pdf["handler"], strict=True):
                base = {"path": path, "handler": handler}
                try:
                    for fact in parse[handler](path, bytes(content)):
                        if "node" in fact:
                            key, label, props = fact["node"]
                            rows.append(base | {"kind": "node", "key": key, "label": label, "props": {k: str(v) for k, v in props.items()}})
                        else:
                            src, dst, kind = fact["edge"]
                            rows.append(base | {"kind": "edge", "src": src, "dst": dst, "type": kind})
                except Exception as e:  # a file that cannot be parsed is reported, the others go on
                    rows.append(base | {"kind": "error", "error": f"{type(e).__name__}: {e}"})
            names = [c.split()[0] for c in FACTS.split(", ")]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    claimed = route(files, by).filter("handler is not null").select("path", "content", "handler")
    return claimed.mapInPandas(run, FACTS)


def read_tree(spark, path: str, most_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """path and content of the files under a folder, up to a size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") <= most_bytes).select("path", "content")
