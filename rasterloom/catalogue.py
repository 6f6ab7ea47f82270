"""The registered queries by name and their SQL."""

from __future__ import annotations

from .plans import checks, designs, files, landforms, layouts, populations, rasters, reports, searches, surveys, waters, worlds

MODULES = (populations, rasters, landforms, files, designs, reports, waters, layouts, searches, surveys, worlds, checks)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
