"""Registered queries over the star schema and the event table, with their SQL."""
