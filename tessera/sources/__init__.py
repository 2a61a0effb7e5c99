"""Readers of raw objects, and the sinks of every layer."""
