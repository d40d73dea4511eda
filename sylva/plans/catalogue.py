"""All queries of the crown engine with the SQL that checks them."""

from __future__ import annotations

from sylva.plans import evaluation, files, rasters, shapes, tiles, udfs, vectors

MODULES = (vectors, tiles, rasters, evaluation, udfs, files, shapes)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: text for m in MODULES for name, text in m.ORACLES.items()}
