"""cohortry: cohort analytics on Spark DataFrames.

Every function takes and returns DataFrames (or Columns) and stays lazy unless
its docstring says that it runs a job.
"""

__version__ = "0.1.0"
