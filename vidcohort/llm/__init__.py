"""Training-data pipeline operators.

Nothing else in the library imports this subpackage; its queries are registered by
``__spark_entry__`` only when the subpackage is present.
"""
