"""Registered queries over the driver's tables and their SQL twins."""

from . import cleaning, dashboard, eda, forecast, kpis, profile, scalars, storage, stream  # noqa: F401
from .base import REGISTRY

__all__ = ["REGISTRY"]
