"""Declarative queries: expressions, a query tree with a builder, and the engine's verbs."""
