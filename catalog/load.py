"""Imports every module that registers queries."""

from importlib import import_module

MODULES = ("sessions", "elements", "cleaning", "windowed", "dims", "rules", "detail", "insights", "deep", "heroes", "acts", "refdata", "pipeline")


def load_all() -> None:
    for name in MODULES:
        import_module(f"catalog.{name}")
