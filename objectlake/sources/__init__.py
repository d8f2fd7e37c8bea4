"""JSON sources and sinks, and log segments."""
