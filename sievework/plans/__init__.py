"""All queries over the driver's tables."""

from . import core, curation, evidence, images, io, metrics, select, text
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "core", "curation", "evidence", "images", "io", "metrics", "select", "text"]
