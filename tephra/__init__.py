"""Spark-first analytics over file indexes, disk images and extracted documents."""
