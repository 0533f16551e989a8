"""Planning helpers: tables that cut lineage, sequence numbers, relations derived from the driver's tables."""
