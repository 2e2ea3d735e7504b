"""leafmill: document-extraction analytics expressed as Spark DataFrame operators."""
