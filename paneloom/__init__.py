"""paneloom: trade-panel analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame. Nothing is collected
on the way except model-sized objects (coefficients, moment matrices).
"""

__version__ = "0.1.0"
