"""Registered queries with their SQL, by theme."""
