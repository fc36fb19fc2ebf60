"""Readers. Each reads all schedules of a campaign in one distributed scan."""
