"""Training-data operators: text and embedding jobs that run as Spark stages.

Nothing outside this subpackage imports it; ``queries`` lists its queries.
"""
