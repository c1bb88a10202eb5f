"""Configuration, the step registry and whole runs."""
