"""Graphs from the test tables, whole workloads and the registered queries."""
