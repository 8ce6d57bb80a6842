"""Logit models fitted and summarised through Spark aggregates."""
