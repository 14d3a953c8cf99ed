"""Streams: what a grid shows of an event stream, and the edit journal as a stream."""
