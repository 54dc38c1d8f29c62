"""Speaker segmentation, voiceprint search and corpus preparation on Spark DataFrames."""
