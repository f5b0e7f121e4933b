"""The operators. Importing the package registers their relations and queries."""

from ..plans import adapters
from . import assembly, findings, hiring, incumbents, lifecycle, pages, reports, robots, scores, sitemaps, sites

__all__ = ["adapters", "assembly", "findings", "hiring", "incumbents", "lifecycle", "pages", "reports", "robots", "scores", "sitemaps", "sites"]
