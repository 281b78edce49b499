"""isoloom: sequence, transcript-structure and corpus analytics as Spark DataFrame operators."""
