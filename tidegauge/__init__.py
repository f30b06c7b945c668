"""tidegauge: early-window sensor analytics on Spark DataFrames.

Operators live in ``tidegauge.operators``, column expressions in
``tidegauge.functions``, readers and writers in ``tidegauge.sources``, and the
composed study stages in ``tidegauge.plans``.  Every operator takes DataFrames
plus column names and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
