"""codequarry: code-intelligence analytics on PySpark.

Tables in, DataFrames out.  ``functions`` holds pure Column builders,
``operators`` relational queries, ``sources`` readers and parsers, ``plans``
composite queries, ``streaming`` the incremental side.  ``llm`` holds
training-data operators and stands alone: nothing else here imports it.
"""
