"""Revolving-credit portfolio analytics as lazy Spark DataFrame operators."""
