"""belegwerk: source-grounded retrieval and verification as Spark DataFrame operators."""
