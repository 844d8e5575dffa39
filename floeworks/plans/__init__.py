"""Registered queries: operators over the test tables, with SQL of equal result."""
