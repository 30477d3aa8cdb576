"""Registered queries, grouped by area."""


def all_queries() -> dict:
    from slicewise.plans import (control, etl, forecasting, ingest, learning, live,  # noqa: F401
                                 profiling, reports, windowing)
    from slicewise.plans.registry import QUERIES
    return dict(QUERIES)
