"""locusmill: Spark-native operators for the bias analysis of perturbation screens."""
