"""What the driver contract adds when this subpackage is present."""

from __future__ import annotations

from slicewise.llm.common import ORACLES, QUERIES, Query


def llm_queries() -> dict[str, Query]:
    from slicewise.llm import queries  # noqa: F401  (registers on import)
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    from slicewise.llm import oracle  # noqa: F401  (registers on import)
    return dict(ORACLES)
