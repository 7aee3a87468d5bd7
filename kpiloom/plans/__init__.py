"""Whole queries over the given tables, composed from the operators."""

from importlib import import_module

_MODULES = [
    "kpi_queries", "report_queries", "catalog_queries", "mapping_queries", "governance_queries",
    "profile_queries", "ingest_queries",
]


def load_queries() -> None:
    """Import every query module so that it registers its queries."""
    for module in _MODULES:
        import_module(f"kpiloom.plans.{module}")
