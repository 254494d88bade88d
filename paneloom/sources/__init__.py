"""Sources and sinks: text tables with typed headers, CSV tables, keyed stores, array files."""
