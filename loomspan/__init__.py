"""loomspan: transcript, metadata and log analytics as plain PySpark DataFrame transformations."""
