"""Training-data operators: filters, duplicate removal, search, mixing and sharding over document tables."""
