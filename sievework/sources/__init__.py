"""Readers and writers for delimited files, stage tables and text summaries."""
