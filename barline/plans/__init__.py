"""Registered queries by subject."""

from importlib import import_module

SUBJECTS = ["indicators", "series", "scanning", "markets", "backtests", "newsplans", "decisionplans", "sourceplans", "liveplans", "patternplans", "timeframes"]


def load():
    from barline.plans import registry

    for s in SUBJECTS:
        import_module(f"barline.plans.{s}")
    return registry.QUERIES, {n: registry.compose(*o) for n, o in registry.ORACLES.items()}
