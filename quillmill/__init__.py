"""Knowledge analytics on Spark DataFrames: documents, sections, entity merging, graphs, wiki pages, search and lint."""

__version__ = "0.1.0"
