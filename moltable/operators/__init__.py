"""Operators of moltable."""
