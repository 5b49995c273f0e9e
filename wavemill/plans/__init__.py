"""Registered queries: each module has QUERIES (name -> callable) and ORACLE (name -> SQL)."""
