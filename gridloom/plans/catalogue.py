"""All named queries of the reference's own operators, and their SQL twins."""

from gridloom.plans import allocation_queries, calibration_queries, composite_queries, distance_queries, further_queries, holdout_queries, metric_queries, model_queries, scalar_queries, select_queries, source_queries, spatial_queries, stencil_queries, surface_queries, tile_queries  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = metric_queries.dti_pooled_by_fold

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
