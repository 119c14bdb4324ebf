"""mailsift: mail-corpus preparation, screening and evaluation as Spark jobs.

Every function takes and returns DataFrames or Columns; none creates a session.
"""
