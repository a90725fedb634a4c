"""All registered queries by name: (Spark query, SQL check or None)."""

from __future__ import annotations

import importlib

FAMILIES = [
    "text", "evaluation", "ensembles", "telemetry", "service", "learning", "streams", "exports",
]


def registered() -> dict:
    out: dict = {}
    for family in FAMILIES:
        found = importlib.import_module(f"textgauge.plans.{family}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out
