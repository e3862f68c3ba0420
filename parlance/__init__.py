"""parlance: Spark-native data work around chat models.

DataFrame in, DataFrame out. Sub-packages:

* ``sources``   – scans, record contracts and sinks
* ``functions`` – Column-level helpers (strip, safe slice, URL quoting, order keys)
* ``operators`` – templates, tokens, batches, generation, tools, conversations, reports, metrics
* ``plans``     – multi-stage plans (global rank, prefix scans) and the registered queries
* ``streaming`` – Structured Streaming versions of the incremental operators
"""

__version__ = "0.1.0"
