"""Operators on model-training text. Nothing outside this folder imports it."""
