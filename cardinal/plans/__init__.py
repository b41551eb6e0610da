"""Algorithms, the benchmark runner and the registered queries."""
