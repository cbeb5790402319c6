"""Operators for preparing training text at scale; nothing outside imports this subpackage."""
