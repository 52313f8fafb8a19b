"""Operators for preparing the project's texts and pages as training data; nothing else in the library imports this."""
