"""signalsieve: item intelligence over posts and feeds, as Spark DataFrame jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns).
Nothing here opens a network connection or keeps a session of its own.
"""
