"""Column functions: text, digests, URIs, schedules."""
