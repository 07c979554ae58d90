"""chatframe: a PySpark-native analytics engine for pasted chat transcripts."""
