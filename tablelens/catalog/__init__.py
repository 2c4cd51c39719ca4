"""All registered queries; importing the submodules fills the registry."""

from tablelens.catalog.base import ORACLE, QUERIES  # noqa: F401
from tablelens.catalog import (  # noqa: F401,E402
    analysis, charts, clean, describe, groups, plans, profile, retrieval, sources, text, timeseries,
)
