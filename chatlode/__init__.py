"""chatlode: a Spark-first engine for archives of conversations and documents."""
