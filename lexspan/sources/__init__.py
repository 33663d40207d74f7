"""Readers and converters from formats to text."""
