"""DuckDB SQL that each registered query must agree with."""

import importlib

MODULES = ["selection", "facts", "governed", "audits", "charts", "extraction", "taxonomy", "activity"]


def load() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"{__name__}.{name}").SQL)
    return out
