"""Column-to-Column rules. All run inside the JVM except ``similarity``."""
