"""Incremental forms: files that arrive are added to a store batch by batch; events by event time."""
