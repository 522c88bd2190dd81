"""Registered queries: operators bound to the sample tables, with the SQL they must agree with."""
