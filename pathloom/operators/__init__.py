"""Operators over whole datasets: where one row isn't enough."""
