"""Row-local steps on a stream of flows."""

from flowlens.streaming.score import flag_stream, read_stream, write_stream

__all__ = ["flag_stream", "read_stream", "write_stream"]
