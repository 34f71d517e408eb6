"""plotline: property-market analytics as lazy Spark DataFrame operators.

Every public operator takes DataFrames (plus column-name parameters) and returns a
DataFrame.  Nothing is collected to the driver; aggregation, joins and windows are
left to Catalyst/AQE.  See README.md for the operator map.
"""

__version__ = "0.1.0"
