"""Field-level evaluation of document extraction, as Spark plans."""
