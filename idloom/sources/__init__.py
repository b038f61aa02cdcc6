"""Sources and sinks: files, recognised text, images, JSON."""
