"""DataFrame operators: retrieval, hierarchy, fusion, evaluation, generation."""
