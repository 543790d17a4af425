"""Log adapters, generators, formats and wire text."""
