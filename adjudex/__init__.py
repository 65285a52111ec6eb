"""Analysis of typed judgments on Spark: records, questions, answers, corpora, calibration, metrics, text signals."""
