"""Named queries that bind the operators to tables, each with its SQL oracle."""

from __future__ import annotations

import importlib

MODULES = ("q_panel", "q_stats", "q_trees", "q_space", "q_text", "q_eval", "q_support", "q_feeds", "q_compare")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"fathomline.plans.{name}")
