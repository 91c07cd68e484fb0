"""Incremental use of the batch operators with Structured Streaming (an extension; see the README)."""
