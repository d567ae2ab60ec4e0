"""assayline: quality analytics for code bases, AI answers and test runs, as Spark DataFrame operators."""
