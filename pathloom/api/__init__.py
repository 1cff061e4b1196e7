"""The engine and its views."""

from pathloom.api.engine import Engine
from pathloom.api.view import View, column, criteria

__all__ = ["Engine", "View", "column", "criteria"]
