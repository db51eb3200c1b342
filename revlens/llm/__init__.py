"""Training-data pipeline operators (numbered 1 to 10) and their queries.

Nothing else in the library imports this subpackage; ``__spark_entry__``
adds its queries only when it can be imported.
"""
