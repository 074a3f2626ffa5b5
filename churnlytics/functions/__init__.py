"""Scalar column functions (Column -> Column)."""

from churnlytics.functions.columns import *  # noqa: F401,F403
