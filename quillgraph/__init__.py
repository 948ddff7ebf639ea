"""quillgraph: document-to-knowledge-graph analytics as PySpark DataFrame plans."""
