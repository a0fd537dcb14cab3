"""folioflow: analytics over page-structured documents, expressed as Spark DataFrame plans."""
