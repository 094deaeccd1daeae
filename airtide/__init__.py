"""A PySpark-native analytics engine for respiratory imaging and waveform data."""
