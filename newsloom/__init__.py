"""A PySpark-native engine for news intelligence: scans, policy operators, entity resolution, publication, read views."""
