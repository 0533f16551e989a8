"""Sources and sinks: file trees, loose objects, reference catalogs."""
