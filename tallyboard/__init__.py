"""Tallyboard: DataFrame operators for logs of two-sided contests."""

from tallyboard.session import build_session, stage

__all__ = ["build_session", "stage"]
