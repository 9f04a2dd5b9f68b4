"""Streams: texts as they arrive, and events in windows of their time."""
