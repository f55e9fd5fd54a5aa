"""Sources and sinks: the given tables, derived capture tables, the request-log
store, routing configuration and JSON export."""
