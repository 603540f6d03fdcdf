"""threadline: analytics over assistant and tool transcripts, as Spark jobs.

Every operator takes and returns DataFrames, keeps no global state and leaves
planning to Catalyst.  Subpackages: ``sources`` (scans and sinks), ``functions``
(column expressions), ``operators`` (table jobs), ``plans`` (registered queries
with their SQL equivalents) and ``streaming``.
"""
