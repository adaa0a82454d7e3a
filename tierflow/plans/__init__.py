"""Registered queries and the SQL each is checked against."""

from importlib import import_module

MODULES = ["prompts", "feedback", "convo", "datasets", "models"]


def _collect(kind):
    out = {}
    for m in MODULES:
        out.update(getattr(import_module(f"tierflow.plans.{m}"), kind))
    return out


def queries():
    return _collect("QUERIES")


def oracle_sql():
    return _collect("ORACLE")
