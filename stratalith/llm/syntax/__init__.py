"""Syntax checks of source files by parsing with derivatives."""
