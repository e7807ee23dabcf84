"""Readers and sinks: JSON lines, TEI headers, binary files, atomic JSON and record artifacts."""
