"""Event streams: sources, keyed state, window rules and the micro-batch job."""
