"""Spark-native spatial assignment analytics.

The names below load with their module when they are first used.
"""

from __future__ import annotations

from importlib import import_module

_EXPORTS = {
    "session": "session",
    "radius_join": "operators.spatial",
    "nearest": "operators.spatial",
    "neighbours": "operators.spatial",
    "checked_join": "operators.contracts",
    "ContractError": "operators.contracts",
    "log_likelihood": "operators.likelihood",
    "Settings": "operators.em",
    "Profiles": "operators.profiles",
    "Policy": "operators.policy",
    "read_table": "sources.tables",
    "write_table": "sources.sinks",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module = import_module(f".{_EXPORTS[name]}", __name__)
    return module if name == "session" else getattr(module, name)


def __dir__() -> list[str]:
    return __all__
