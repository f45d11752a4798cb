"""mmcohort — Spark-native multimodal, multi-label cohort preparation, scoring and evaluation."""

__version__ = "0.1.0"
