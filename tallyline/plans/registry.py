"""Importing this module registers every query."""

from tallyline.plans.checks import QUERIES, SQL, cycles, drawings, sheets, texts  # noqa: F401
