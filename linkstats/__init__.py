"""A/B link-measurement analytics on Spark.

Raw probe files, modem state and resource samples come in as DataFrames, every
probe is joined with the state that held when its run began, and the baseline
and treatment arms are compared in per-schedule summaries and reports.
"""

__version__ = "0.1.0"
