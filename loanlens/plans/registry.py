"""Public registry used by ``__spark_entry__``."""

from __future__ import annotations

from loanlens.plans import catalog, catalog_models  # noqa: F401 (registers queries)


def queries():
    return dict(catalog.QUERIES)


def oracle_sql():
    return dict(catalog.ORACLE)
