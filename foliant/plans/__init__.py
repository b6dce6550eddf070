"""Registered queries; importing the modules fills the registry."""

from . import q_classify, q_dedup, q_extract, q_filters, q_orders, q_reports, q_sources, q_streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
