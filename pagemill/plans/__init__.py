"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from . import corpus, defaults, keyed, layout_plans, lines_plans, pages_plans, quality, requests_plans, terms, views_plans, work  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
