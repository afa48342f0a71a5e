"""Health and structure reports over database catalog snapshots of a fleet.

Every report is a function from a :class:`~fleetlens.sources.catalog.Catalog`
to a DataFrame, so one Spark job answers for all clusters and all snapshots.
"""

from fleetlens.sources.catalog import Catalog

__all__ = ["Catalog"]
