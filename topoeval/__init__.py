"""PySpark-native operators for graph topologies and the tables of experiments on them."""
