"""Readers: the tables of a data folder and the fixtures derived from them."""
