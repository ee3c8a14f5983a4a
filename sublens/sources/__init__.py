"""Sources and sinks: typed schemas, the fixture derivation, CSV readers/writers."""
