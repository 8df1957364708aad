"""quillmark: literature curation and evidence analytics on Apache Spark."""
