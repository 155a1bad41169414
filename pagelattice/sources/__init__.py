"""Readers and writers: PAGE-XML, JSON, CSV, text, binary."""
