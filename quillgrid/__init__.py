"""quillgrid: a Spark-first analytics engine for scholarly document collections."""
