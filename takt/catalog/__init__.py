"""All registered queries and their SQL twins."""
from importlib import import_module

MODULES = ["flow", "quality", "evaluate", "rollup", "hidden", "records", "validate", "streams", "learn"]


def collect():
    queries, oracle = {}, {}
    for name in MODULES:
        m = import_module(f"takt.catalog.{name}")
        queries.update(m.QUERIES)
        oracle.update(m.ORACLE)
    return queries, oracle
