from .live import live_location_summary, read_observation_stream, score_stream  # noqa: F401
