"""Training-data operators: filtering, scoring, deduplication, mixing and sharding of documents."""
