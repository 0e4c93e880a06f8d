"""strandweave: sequencing records and their annotation as Spark DataFrames.

``functions`` hold Column expressions, ``operators`` DataFrame transformations, ``sources`` the file formats,
``plans`` the registered queries, ``streaming`` the Structured Streaming forms and ``support`` driver-side helpers.
"""

__version__ = "0.1.0"
