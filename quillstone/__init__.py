"""A PySpark-native analytics engine for collections of notes, documents and messages."""
