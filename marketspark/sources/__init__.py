"""Sources and sinks: captured tables, config files, exports, upserts at rest."""
