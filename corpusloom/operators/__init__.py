"""DataFrame operators: chunking, indexes, retrieval, fusion, evidence, evaluation, lifecycle."""
