"""Public-works risk analytics as Spark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns them; nothing runs until the caller writes or
collects the result.  See ``README.md`` for the map from operator ids to modules.
"""
