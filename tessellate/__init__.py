"""A Spark-native engine for web evidence: extraction, classification, scoring and corpus analytics."""
