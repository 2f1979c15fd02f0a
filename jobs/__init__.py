"""Runnable jobs over the given tables: each a function that takes a session, and a command line."""
