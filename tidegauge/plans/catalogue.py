"""The registered queries by name, and DuckDB SQL for those that it can express."""

from tidegauge.plans import dates, further, importance, ingestion, more, panel, scoring, suites, tiled  # noqa: F401
from tidegauge.plans.base import ORACLES, QUERIES  # noqa: F401
