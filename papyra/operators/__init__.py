"""DataFrame operators: chunking, indexing, retrieval, filing, storage, evaluation."""
