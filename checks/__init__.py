"""Wiring of the operators to the driver tables, with independent SQL to compare against."""

from importlib import import_module
from pathlib import Path


def load_queries() -> None:
    for module in sorted(Path(__file__).parent.glob("q_*.py")):
        import_module(f"checks.{module.stem}")
