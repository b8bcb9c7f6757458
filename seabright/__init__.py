"""A PySpark-native analytics engine for towed side-scan sonar surveys."""
