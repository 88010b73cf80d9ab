"""Errors that end a job, as opposed to rows that are set aside and counted."""

from __future__ import annotations


class LoadError(RuntimeError):
    """A snapshot could not be loaded; what was published before is untouched."""


class GroundingError(RuntimeError):
    """There is no vocabulary to resolve names against."""


class UnknownModelError(KeyError):
    """Calls name a model without a rate, so their cost is unknown rather than zero."""


class UnknownFieldError(ValueError):
    """A statistic was asked for on a column that is not open to filtering."""


class InvalidFilterError(ValueError):
    """A request's bounds, ids or names break the rules of their fields."""
