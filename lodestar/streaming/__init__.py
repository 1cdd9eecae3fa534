"""Stateful stream operators and their batch twins."""
