"""Whole jobs: reports, task arrays, chunked jobs, scheduling and status."""
