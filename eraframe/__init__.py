"""Event-chronology ETL and interval analytics on PySpark DataFrames.

functions/  Column builders (years, keys, titles, labels, date-span rules)
operators/  joins, windows, dedupe, categories, lane layout
sources/    artifact, page and curated readers; writers and loads
plans/      composite queries built from the above
streaming/  Structured Streaming jobs over an event log
"""
