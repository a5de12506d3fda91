"""Relational operators: enumeration, scoring, matching, metrics, selection."""
