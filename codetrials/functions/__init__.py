"""Column-level helpers: everything here is ``Column -> Column`` and runs inside the JVM."""
