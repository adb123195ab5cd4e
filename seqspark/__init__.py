"""seqspark: ordered-sequence analytics expressed as lazy Spark DataFrame plans."""
