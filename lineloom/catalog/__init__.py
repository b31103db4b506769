"""Registered queries, grouped by area."""

import importlib

AREAS = ("curation", "audit", "series", "vectors", "evaluation")


def load():
    """The registry with every area imported."""
    for area in AREAS:
        importlib.import_module(f"lineloom.catalog.{area}")
    return importlib.import_module("lineloom.catalog.registry")
