"""Importing this package registers all queries."""

from . import cf, factor, prep, profile, text, web

__all__ = ["cf", "factor", "prep", "profile", "text", "web"]
