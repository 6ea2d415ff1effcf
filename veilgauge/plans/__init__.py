"""Composite dataflows: the test population, the games and the query catalogue."""
