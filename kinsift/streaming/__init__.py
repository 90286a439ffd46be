"""Structured Streaming: an extension, batch operators applied to arriving submissions."""
