from furrow.streaming.incremental import read_period_means, stream_period_sums

__all__ = ["stream_period_sums", "read_period_means"]
