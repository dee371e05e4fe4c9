"""A directory engine on Spark: extraction, cleaning, linking, retrieval, ranking and event feeds as DataFrame operators."""
