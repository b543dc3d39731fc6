"""Named queries over a data directory, and the SQL they are compared with."""

from __future__ import annotations

import importlib
import pkgutil

QUERIES: dict = {}
SQL: dict[str, str] = {}

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    _module = importlib.import_module(f"{__name__}.{_m}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
