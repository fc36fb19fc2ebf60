"""Whole jobs: load a campaign, build its views and summaries, run its reports."""
