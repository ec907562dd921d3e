"""Quality-incident analytics on Spark DataFrames.

Extracts of several source systems are mapped to one schema, cleaned, added to
a fact table once per real-world incident, and served as DataFrame views.
"""
