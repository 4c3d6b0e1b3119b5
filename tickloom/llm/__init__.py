"""Operators for training text and event streams; nothing outside this subpackage imports it."""
