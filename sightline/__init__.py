"""Sightline: picture-provenance analytics as Spark jobs over many investigations at once."""

__version__ = "0.1.0"
