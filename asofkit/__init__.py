"""Point-in-time clickstream features and ranking evaluation on Apache Spark."""
