"""The session operators on a growing log."""
