"""All registered queries with their SQL twins."""

from __future__ import annotations

from . import attributes, forests, iterated, mining, silhouettes, tables

MODULES = [silhouettes, attributes, mining, forests, tables]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in [*MODULES, iterated] for k, v in m.ORACLES.items()}
