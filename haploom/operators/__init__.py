"""Operators of the phasing engine."""
