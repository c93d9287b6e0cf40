"""Configurations and the facade that composes operators."""
