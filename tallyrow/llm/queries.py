"""All queries of the subpackage."""

from tallyrow.llm import combojoin, contamination, convtrie, filteraudit, licenses, maintext, mixing, neardup, ordermin, quality, repeats, reputation, tokens
from tallyrow.llm.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "combojoin", "contamination", "convtrie", "filteraudit", "licenses", "maintext", "mixing", "neardup", "ordermin", "quality", "repeats", "reputation", "tokens"]
