"""Imports every plan module so that its queries register."""

from meltwise.plans import correction_queries, curation_queries, feature_queries, metric_queries, ml_queries, neighbour_queries, question_queries, retrieval_queries, source_queries, streaming_queries, validate_queries  # noqa: F401
