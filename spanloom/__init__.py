"""Text analytics over stand-off span annotations, planned by Spark."""
