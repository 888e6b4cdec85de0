"""Sources: parsers of connector payloads, and readers of document files."""
