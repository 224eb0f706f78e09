"""Structured Streaming jobs: observation folding and resumable scans."""
