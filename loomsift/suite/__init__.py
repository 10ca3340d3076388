"""All registered queries with the SQL they are compared with."""

from __future__ import annotations


def _load() -> None:
    from loomsift.suite import documents, payloads, runs, sinks, streams  # noqa: F401


def queries():
    from loomsift.suite import base

    _load()
    return dict(base.QUERIES)


def oracles():
    from loomsift.suite import base

    _load()
    return dict(base.ORACLES)
