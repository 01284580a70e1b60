"""Batch jobs over the speech, object and hand-tracking outputs of recorded work sessions.

`sources` reads and writes documents and tables, `functions` holds column
expressions, `operators` the joins, aggregates and rules, `plans` the registered
queries, `streaming` the file-drop trigger. Functions take and return DataFrames
or Columns and start no job, except where their docstring says so.
"""
