"""lithos: tabular-to-geoscience-object ETL and object catalog on Spark.

Layers
------
sources/    scans: typed CSV with missing-value words, file listings, the driver tables
functions/  column expressions (text cleaning, numeric coercion, JSON references, ISO time)
operators/  DataFrame -> DataFrame operators: row position, quality gate, profile,
            dictionary encoding, hole indexes, typed arrays, catalog relations
plans/      composite object builders and the registered queries on the driver tables
"""

__version__ = "0.1.0"
