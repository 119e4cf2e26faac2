"""Replies that arrive as streams of frames."""
