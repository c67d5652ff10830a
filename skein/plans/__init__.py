"""Queries by name. Importing the package registers all of them."""

from . import composite, graphs, language, registry, relational, sources, streams, strings

__all__ = ["registry"]
