"""Report operators. Each takes a ``Portfolio`` and returns a lazy DataFrame."""
