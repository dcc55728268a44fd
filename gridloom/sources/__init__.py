"""Sources and sinks: scene listings, metadata, mappings, arrays, datasets."""
