"""Structured Streaming: chunks in, frames out."""
