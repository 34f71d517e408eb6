"""Sources (driver tables, CSV/JSON/HTML listing inputs) and sinks."""
