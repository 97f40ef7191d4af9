"""Connectors: files, and pages fetched over a transport that the caller gives."""
