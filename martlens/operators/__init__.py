"""Relational building blocks: period filter, joins, rollups, rankings."""
