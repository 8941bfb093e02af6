"""newsloom: article analytics as lazy PySpark DataFrame operators."""
