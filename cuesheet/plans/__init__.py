"""Query plans over the driver's tables."""

from importlib import import_module

MODULES: tuple[str, ...] = ("sampling", "stats", "timeaxis", "text", "similarity", "claims", "tables", "matching", "stream")


def load_all() -> None:
    for name in MODULES:
        import_module(f"cuesheet.plans.{name}_queries")
