"""codecorpus: source collections, call graphs, traces and run journals as Spark tables."""
