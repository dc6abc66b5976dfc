"""combisieve: table work for very large combinatorial screening libraries, on Spark.

Every function takes a DataFrame first and returns a DataFrame.  Nothing here
keeps rows on the driver; only bounded aggregates (bucket totals, size
histograms, vocabularies of a checked size) are ever collected.
"""

TARGETS = ("BRD4", "HSA", "sEH")

__all__ = ["TARGETS"]
