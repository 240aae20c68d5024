"""profloom: Spark-native harmonization of image-based cell profiles and large record sets."""

__version__ = "0.1.0"
