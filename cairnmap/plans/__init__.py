"""Compositions of operators and the registered queries."""

from importlib import import_module

_MODULES = ("stage_queries", "run_queries", "model_queries")


def register_all() -> None:
    for name in _MODULES:
        import_module(f"cairnmap.plans.{name}")
