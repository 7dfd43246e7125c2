"""All registered queries."""

from panelkit.plans import metric_queries, model_queries, panel_queries  # noqa: F401
from panelkit.plans.catalog import ORACLES, QUERIES  # noqa: F401
