"""parcel: listing ingestion, feature and valuation operators on Spark DataFrames."""

__version__ = "0.1.0"
