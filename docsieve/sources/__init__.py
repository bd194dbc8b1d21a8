"""Sources and sinks: synthetic corpora, JSON lines, reports."""
