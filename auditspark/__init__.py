"""auditspark: fleet-scale code-audit analytics on Spark DataFrames.

Every operator takes and returns DataFrames keyed by ``repo_id``; nothing is
collected to the driver. See README.md for the module map.
"""

__version__ = "0.1.0"
