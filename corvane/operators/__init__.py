"""Corvane operators."""
