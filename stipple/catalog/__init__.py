"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

import importlib

from stipple.catalog.registry import ENTRIES, Entry

MODULES = ("displacement", "hierarchy", "saved", "groups", "metrics", "pixels", "geometry", "inference", "sources", "streams")


def load() -> dict[str, Entry]:
    for name in MODULES:
        importlib.import_module(f"stipple.catalog.{name}")
    return ENTRIES
