"""The modules that register queries."""

from __future__ import annotations

import importlib

NAMES: tuple[str, ...] = ("sequences", "lookups", "statistics", "candidates", "decoders", "learning", "contacts", "learners", "structural", "evidence")


def load() -> None:
    """Import every plan module once."""
    for name in NAMES:
        importlib.import_module(f"strataflow.plans.{name}")
