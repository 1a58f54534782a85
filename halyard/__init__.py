"""halyard: a Spark-first engine for revision-prone measurement series."""
