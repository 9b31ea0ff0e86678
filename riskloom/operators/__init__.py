"""Analytic operators over one wide table."""
