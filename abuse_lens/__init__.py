"""abuse_lens: traffic-abuse analytics on Spark DataFrames.

Cumulative per-source TCP counters, packet tables, payload events and host
samples go in; per-interval deltas, abuse episodes, the counterfactual impact
of blocking and a readiness verdict come out.  Nothing here enforces anything.
"""

__version__ = "0.1.0"
