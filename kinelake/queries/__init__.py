"""Every operator run over the driver's tables, next to the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

from kinelake.queries.registry import ORACLES, QUERIES

for _name in ("windowing", "signal", "catalog", "evaluation", "review", "models", "live"):
    try:
        import_module(f"kinelake.queries.{_name}")
    except ModuleNotFoundError as exc:
        if exc.name != f"kinelake.queries.{_name}":
            raise

__all__ = ["ORACLES", "QUERIES"]
