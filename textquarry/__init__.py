"""textquarry: document preparation, search and catalogue analytics on PySpark DataFrames."""
