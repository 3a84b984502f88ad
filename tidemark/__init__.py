"""tidemark: a PySpark-native engine for ambient text history.

Activity signals become sessions, captured text is cleaned, redacted, chunked
and deduplicated, everything is stored by ISO week, and recall queries fuse
keyword, vector and recency rankings.
"""
