"""Queries over the tables of a folder."""

from quarry.plans.flagship import flagship

__all__ = ["flagship"]
