"""Column expressions over vectors and texts; all of them run in the JVM."""

from tessella.functions import text, vector

__all__ = ["text", "vector"]
