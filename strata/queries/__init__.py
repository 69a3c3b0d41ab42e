"""Queries over the test tables with SQL that gives the same rows."""
