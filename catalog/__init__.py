"""Registered queries, each with the SQL that has to give the same rows."""
