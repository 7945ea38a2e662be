"""Registered queries and their SQL."""

from . import corpus, registry  # noqa: F401
