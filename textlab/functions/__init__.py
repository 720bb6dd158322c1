"""textlab: text-classification data work on Spark."""
