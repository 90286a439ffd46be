"""kinsift: document and code similarity analytics on PySpark."""
