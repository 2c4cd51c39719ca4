"""tablelens: exploratory table analysis as Spark DataFrame operators.

Every operator takes a DataFrame (plus column names and options) and returns a
lazy DataFrame. Nothing is collected except where the *shape* of the next plan
depends on the data (semantic types, dropped columns), and those round trips
return at most one row per column.
"""

from tablelens.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
