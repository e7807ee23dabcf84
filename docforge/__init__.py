"""docforge: document and citation evidence analytics as PySpark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is collected inside an operator
except bounded, documented summaries. Sub-packages:

* ``functions``  Column expressions (text forms, identifiers, dates, ratios)
* ``operators``  relational operators (structure, cleaning, evidence, matching, scoring ...)
* ``sources``    readers and sinks
* ``plans``      shared-folder tables, session settings, registered queries with their SQL
* ``streaming``  Structured Streaming variants
"""

__version__ = "0.1.0"
