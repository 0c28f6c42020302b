"""Sources and sinks: tables, files, archives, event streams and records."""
