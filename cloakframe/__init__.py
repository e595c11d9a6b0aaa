"""PySpark-native detection, rewriting and linking of personal data in text."""
