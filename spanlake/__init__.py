"""Agent-trace analytics on Spark. Names are imported when first used, so that Python workers start light."""

from importlib import import_module

__version__ = "0.1.0"
_HOMES = {
    "spanlake.schema": ("SPEC", "SPEC_VERSION", "SPANS", "MESSAGES", "DOCUMENTS", "LINKS", "TRACES", "SESSIONS", "SCHEMAS"),
    "spanlake.plans.engine": ("load", "load_payloads", "to_arrow", "to_dfs", "to_dicts", "to_parquet"),
    "spanlake.operators.encode": ("Encoded", "to_arrays", "to_tensors"),
    "spanlake.operators.tables": ("dims",),
}
__all__ = [name for names in _HOMES.values() for name in names]


def __getattr__(name: str):
    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(home), name)
    raise AttributeError(name)
