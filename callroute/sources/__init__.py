"""Sources, sinks, dimensions and test-table adapters."""
