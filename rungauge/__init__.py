"""Trajectory analytics on Spark: assembly, batching, evaluation, monitoring and curation of agent runs."""
