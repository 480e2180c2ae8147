"""terravane: spatial-network and gridded-field analytics on PySpark DataFrames."""
