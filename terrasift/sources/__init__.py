"""Sources and sinks: shapefiles, document lists, keyword indexes, JDBC addresses, configuration."""
