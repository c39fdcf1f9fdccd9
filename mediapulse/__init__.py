"""mediapulse: Spark jobs for media-volume and theme analytics."""
