"""Operators of a training-data pipeline, each with its own general interface.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only where it can be imported.
"""
