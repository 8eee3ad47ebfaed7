"""Purchase, nutrition and training-data analytics as PySpark DataFrame operators."""
