"""Registered queries, each with the SQL that must give the same rows.

A query takes (spark, folder of the given tables). Importing this package loads all
families; ``queries()`` and ``oracles()`` list them.
"""

from __future__ import annotations

from importlib import import_module

from vitrine.catalog.registry import oracles, queries  # noqa: F401

for _family in ("primitives", "cleaning", "warehouse", "kpis", "pages", "profiling", "learning"):
    import_module(f"vitrine.catalog.{_family}")
