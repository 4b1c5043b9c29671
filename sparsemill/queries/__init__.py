"""Queries that show each operator on the test tables, with the SQL that they must agree with."""
