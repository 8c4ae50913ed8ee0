"""Column-expression builders and the few Arrow functions."""
