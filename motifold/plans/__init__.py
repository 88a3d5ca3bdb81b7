"""Whole queries and jobs, composed of the operators."""
