"""revlume: a PySpark-native analytics engine for opinion data."""
