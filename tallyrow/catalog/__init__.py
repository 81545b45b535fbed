"""Registered queries over the test tables, each with the SQL it must agree with."""

from tallyrow.catalog import cleaning, evaluation, features, history, pairs, profile, runlog, scans, sketches, splits, stored
from tallyrow.catalog.base import REGISTRY

__all__ = [
    "REGISTRY",
    "cleaning",
    "evaluation",
    "features",
    "history",
    "pairs",
    "profile",
    "runlog",
    "scans",
    "sketches",
    "splits",
    "stored",
]
