"""microstar: a PySpark engine for loading yearly exam microdata into a star
schema and analysing it (join, profile, robust linear fit, evaluation).

Subpackages
-----------
functions  Column -> Column expressions (labels, recodes, flags, text, numbers)
operators  DataFrame -> DataFrame operators (project, route, reshape, quality,
           profile, joins, ML)
sources    readers and writers (delimited positional text, parquet layers)
plans      end-to-end jobs: exam pipeline, analysis, data dictionary, and the
           query catalog that runs every operator on the driver's tables
streaming  incremental (Structured Streaming) form of the curated load
spec       fixed values of the exam domain (layouts, renames, recodes, labels)
"""

__version__ = "0.1.0"
