"""placeloom: a PySpark-native engine for place and organisation data.

Everything is a lazy DataFrame operator; nothing here collects unbounded data to the driver.
"""

__version__ = "0.1.0"
