"""Column expressions: text forms, identifiers, dates. All run in the JVM."""
