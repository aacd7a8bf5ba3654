"""Evidence-grounded document retrieval and evaluation as Spark DataFrame operators."""
