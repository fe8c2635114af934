"""Registered queries, with the SQL they are held against."""

from . import attributes, codecs, conversions, files, forms, imaging, lookups, messages, pictures, protocol, temporal, updates
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "attributes", "codecs", "conversions", "files", "forms", "imaging", "lookups", "messages", "pictures", "protocol", "temporal", "updates"]
