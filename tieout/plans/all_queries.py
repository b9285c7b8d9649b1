"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("reconcile", "payables", "searching", "documents")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tieout.plans.{name}")
