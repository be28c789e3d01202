"""Streams of events: windows with late data, and progress of jobs as state."""
