"""A document-intelligence and evidence-analytics engine on Spark DataFrames."""
