"""Registered queries and their oracle SQL, by area."""

from parley.catalog import corpus, files, metrics, modelling, phrases, survey

_AREAS = (modelling, metrics, corpus, survey, phrases, files)

QUERIES = {name: run for area in _AREAS for name, run in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
