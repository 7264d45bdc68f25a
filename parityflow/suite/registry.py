"""All registered queries and their SQL, gathered from the topic modules."""

from __future__ import annotations

from parityflow.suite import diffs, fuzzy, operations, plans, runs, schemas, similar, transforms

MODULES = (diffs, plans, runs, transforms, schemas, operations, similar, fuzzy)


def queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
