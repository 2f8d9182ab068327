"""chartlake: set-oriented Spark operators for detections, documents, retrieval and consultation logs."""
