"""Layered e-commerce warehouse on Spark: logs, change records, wide tables and windowed statistics.

Operators are plain ``DataFrame -> DataFrame`` functions. They accept batch tables and
Structured Streaming input alike unless their docstring says otherwise.
"""
