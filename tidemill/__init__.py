"""tidemill: a data workbench and corpus toolkit on Spark DataFrames."""
