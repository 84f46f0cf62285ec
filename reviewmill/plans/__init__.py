"""End-to-end jobs and the registered queries over the driver's test tables."""

from importlib import import_module

_MODULES = ("metric_queries", "cleaning_queries", "matching_queries", "merge_queries", "quality_queries", "stream_queries")


def _load() -> None:
    for name in _MODULES:
        import_module(f"reviewmill.plans.{name}")


def all_queries():
    _load()
    from reviewmill.plans.registry import QUERIES

    return dict(QUERIES)


def all_oracles():
    _load()
    from reviewmill.plans.registry import ORACLES

    return dict(ORACLES)
