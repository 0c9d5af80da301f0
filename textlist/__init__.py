"""Spark-native extraction, scoring and catalogue matching for collections of item lists."""
