"""marl: retrieval and text analytics as lazy PySpark DataFrame transformations."""
