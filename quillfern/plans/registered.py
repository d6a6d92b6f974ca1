"""Imports every module that registers queries."""

from quillfern.plans import q_grouped, q_media, q_series, q_tables, q_text  # noqa: F401
