"""causeway: typed-graph comparison and panel analytics on PySpark DataFrames."""
