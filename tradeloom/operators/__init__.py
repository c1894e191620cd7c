"""Joins, checks and reports over extracted documents."""
