"""Declared sources, readers, row tagging and sinks."""
