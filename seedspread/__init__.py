"""seedspread: influence-maximization queries as PySpark DataFrame jobs."""
