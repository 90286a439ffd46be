"""Whole plans: scans of submissions and the catalogue of queries."""
