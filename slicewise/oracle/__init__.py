"""Independent SQL for every deterministic query."""


def all_oracles() -> dict[str, str]:
    from slicewise.oracle import (batch, control, forecasting, ingest, learning, live, reports,  # noqa: F401
                                  windowing)
    from slicewise.oracle.core import ORACLES, sql
    return {name: sql(body) for name, body in ORACLES.items()}
