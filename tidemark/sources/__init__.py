"""Readers of label files, commit logs, trees, blobs and timing logs, and writers."""
