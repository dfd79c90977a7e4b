"""Graphs that grow: streams of edges."""
