"""Queries over the stand-in tables, and the SQL that checks them."""
