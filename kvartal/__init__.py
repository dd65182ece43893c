"""Spark jobs over classified apartment listings.

Every stage is a function from DataFrame to DataFrame, so a job is written as a
chain of ``df.transform(...)`` calls and Catalyst sees one plan.
"""
