"""Whole investigations composed from the operators."""
