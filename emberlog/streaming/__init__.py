"""The same expressions over streams of files."""
