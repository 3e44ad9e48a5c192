"""Registered queries over the order tables, each with its check in plain SQL where SQL can say it."""

from paneloom.plans.registry import oracle_sql, queries  # noqa: F401
