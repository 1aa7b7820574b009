"""Snapshots, publication, chunkers and the mapping of the test tables."""
