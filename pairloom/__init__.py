"""Text-pair evaluation and sequence preparation as Spark DataFrame operators."""
