"""Column-level building blocks. Everything here returns a ``Column`` and stays JVM-side."""
