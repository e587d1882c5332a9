"""Event streams. Beyond the engine's batch operators: windows over the events table."""
