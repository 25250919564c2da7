"""Relational building blocks: ordering, latest rows, joins and checks."""
