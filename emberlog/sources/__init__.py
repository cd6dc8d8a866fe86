"""Log files, the stored index and the configuration files."""
