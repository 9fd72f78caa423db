"""Registered queries: one module a topic, each with QUERIES and ORACLE dictionaries."""
