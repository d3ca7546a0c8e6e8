"""Operators on text and statistics for language-model data; nothing else in the library imports this."""
