"""quillgraph: graph analytics over marked-up letters and relational tables, planned by Spark."""
