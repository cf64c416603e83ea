"""The registered queries and the SQL each one is checked against."""

from . import browsing, evidence, extras, features, findings, models, profiles, quality, sources
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "browsing", "evidence", "extras", "features", "findings", "models",
           "profiles", "quality", "sources"]
