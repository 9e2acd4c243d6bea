"""shelfmark: catalog analytics, retrieval and personal feeds as Spark jobs.

Every public function takes DataFrames (plus plain parameters) and returns DataFrames.
"""

__version__ = "0.1.0"
