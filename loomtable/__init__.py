"""loomtable: composable PySpark DataFrame operators and ready-made table jobs."""
