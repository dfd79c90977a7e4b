"""Graph and relational analytics over typed property graphs, as DataFrame programs."""
