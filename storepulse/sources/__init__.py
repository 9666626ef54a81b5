"""Sources and sinks: schemas, fixture derivation, table IO."""
