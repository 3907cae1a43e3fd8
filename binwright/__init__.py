"""Single-cell count analytics on Spark DataFrames.

Cells, features, ingests and a long sparse count matrix are plain tables. Every public function
takes DataFrames and returns DataFrames (or writes them), so callers compose operators freely and
Catalyst sees one declarative plan.
"""

__version__ = "0.1.0"
