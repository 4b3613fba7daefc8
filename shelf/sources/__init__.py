"""Readers: file listings, decoded images, box files."""
