"""DataFrame-in, DataFrame-out operators.

`scenario` names an optional leading key (for instance `iteration`), so that many
what-if versions of a log go through one job.
"""
