"""Every registered query of the screening, audit and evidence operators, with its SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    """Registers a query under its function's name, with the DuckDB SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


from . import queries as _queries  # noqa: E402, F401
from . import evidence as _evidence  # noqa: E402, F401
from . import files as _files  # noqa: E402, F401
from . import records as _records  # noqa: E402, F401
