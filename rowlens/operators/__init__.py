"""The comparison engines. Each turns two DataFrames and a plan into one lazily evaluated table of classified rows."""
