"""Errors by what went wrong, so that a caller can tell them apart."""

from __future__ import annotations


class StrandlineError(Exception):
    """Any error of this package that a user can do something about."""


class UsageError(StrandlineError):
    """A command or an option that does not exist or has a value it cannot have."""


class FixtureError(StrandlineError, ValueError):
    """A fixture that cannot be evaluated: unknown fields, no approval, no cases."""


class EvaluationError(StrandlineError):
    """Results that do not fit their cases, or a mismatch in an evaluation that allows none."""


class NoticeError(StrandlineError):
    """The notice that texts leave the machine could not be shown, so nothing was sent."""
