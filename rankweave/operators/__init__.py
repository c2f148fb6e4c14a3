"""Rankweave subpackage."""
